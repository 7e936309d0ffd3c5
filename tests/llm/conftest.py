import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: Columns besides those of documents, with names that operators use inside.
EXTRA = "bands string, spans string, text_key string, id string, ids string, block string, n string, key string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(seed, n, of=400):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def edited(text, seed, n):
    import random

    rng, ws = random.Random(seed), text.split(" ")
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
    return " ".join(ws)


def hard_texts():
    """Copies, near copies, shared passages, nulls, empties, blanks, other scripts, one very long text."""
    base, passage = words(1, 120), words(2, 60)
    out = [None, "", " \t\n", "one", "one two", "One TWO", "one two", "日本語 のテキスト です", "é" * 300, "a" * 900, "ab " * 400]
    out += [base, base, base.upper(), *[edited(base, s, 1 + s % 5) for s in range(25)]]
    out += [f"{words(100 + s, 30)}\n{passage}\n{words(200 + s, 40)}" for s in range(12)]
    out += [words(300 + s, 15 + s) for s in range(20)] + [words(9, 30_000, 5000), edited(words(9, 30_000, 5000), 3, 40)]
    return out


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], len(t or "")) for i, t in enumerate(hard_texts())]
    rows += [rows[11], (None, rows[12][1], None, "b", 1), (None, "no id here", "en", "a", 2)]
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)
