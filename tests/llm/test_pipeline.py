import re
from collections import Counter

import pytest
from oracle import SF
from pyspark.sql import functions as F
from test_dedup import brute_classes
from test_quality import brute_counts, brute_spans

import corpus_pipeline
from strandline.llm.unigram_pieces import decode_pieces, default_model
from strandline.plans.runtime import table


def brute_kept(rows):
    """Documents that pass the rules and stand for their class; no source of these tables is rejected."""
    good = {}
    for r in rows:
        n, *_, again = brute_counts(r["text"])
        if n >= 20 and 100 * again <= 30 * n:
            good[r["doc_id"]] = r["text"]
    classes = brute_classes(list(good.items()), 5, 80)
    return {i: good[i] for i, (_, c) in classes.items() if i == c}


def brute_redacted(text):
    out, last = [], 0
    for a, _, kind, b in brute_spans(text):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def test_stages_and_run(spark):
    rows = table(spark, SF, "documents").collect()
    want = {i: brute_redacted(t) for i, t in brute_kept(rows).items()}
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    out = decode_pieces(corpus_pipeline.run(spark, SF), default_model(spark)).collect()
    assert out and all(r["decoded"] == want[r["doc_id"]] for r in out)
    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in want.items()}
    assert sum(tokens[r["doc_id"]] for r in out) <= sum(tokens.values())
    assert max(Counter(r["doc_id"] for r in out).values()) <= 3


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_hard_rows(spark, hard, none, empty):
    docs = none if empty else hard
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns or name == "pieces"
    assert docs.count() == 0 if empty else docs.count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and F is not None
