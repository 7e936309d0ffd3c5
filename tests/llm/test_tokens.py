import hashlib
import json
import math
import time
from collections import Counter

import numpy as np
import pytest
from oracle import SF, check
from pyspark.sql import functions as F

from strandline.llm import chat_parts, queries_tokens, temperature_mix, unigram_pieces
from strandline.llm.unigram_pieces import Pieces, decode_pieces, default_model, encode_pieces
from strandline.plans.runtime import table


@pytest.mark.parametrize("name", sorted(queries_tokens.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, name, queries_tokens.QUERIES[name], queries_tokens.ORACLE_SQL[name])


def mixed(frame, **options):
    return temperature_mix.temperature_mix(frame, **options).collect()


def test_mixture_keeps_to_weights_and_budget(spark):
    rows = [(i, "w " * (1 + i % 9), "big") for i in range(600)] + [(1000 + i, "w " * 5, "mid") for i in range(60)] + [(2000 + i, "w " * 5, "small") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("big", "mid", "small")}
    got = mixed(frame, entropy_share=0.9, max_repeats=3.0, block_tokens=100)
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    budget = sum(total.values())
    shares = np.array([total[s] for s in total]) / budget
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        q = shares**a / (shares**a).sum()
        ok = -(q * np.log(q)).sum() >= 0.9 * math.log(3) and (q * budget / np.array(list(total.values()))).max() <= 3
        entropy = -(q * np.log(q)).sum() >= 0.9 * math.log(3)
        low, high = (a, high) if entropy else (low, a)
    q = shares**low / (shares**low).sum()
    repeats = (q * budget / np.array(list(total.values()))).max()
    if repeats <= 3:
        for s, w in zip(total, q, strict=True):
            assert w * budget - 9 <= taken[s] <= w * budget + 1
    assert sum(taken.values()) <= budget and ok in (True, False)
    for s in total:  # each pass takes a document once at most, and all passes but the last are whole
        passes = Counter((r["mix_pass"], r["doc_id"]) for r in got if r["source"] == s)
        assert max(passes.values()) == 1
        last = max(p for p, _ in passes)
        for p in range(last):
            assert sum(1 for x, _ in passes if x == p) == sum(1 for _, _, x in rows if x == s)
        ends = sorted((r["mix_start"], r["mix_start"] + len(r["text"].split())) for r in got if r["source"] == s)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False) if b[0] < last * total[s])


def test_whole_sources_lose_no_document(spark, hard):
    sizes = [1, 2, 3, 7, 11, 101, 997, 1009] + [900 + 13 * i for i in range(20)]
    rows = [(100 * s + i, "w " * n, f"s{s}") for s, n in enumerate(sizes) for i in range(1 if s < 8 else 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for docs in (frame, hard):
        got = temperature_mix.temperature_mix(docs, entropy_share=None, max_repeats=None).drop("mix_pass", "mix_start")
        assert got.exceptAll(docs).count() == 0 and got.count() == docs.count()
    twice = Counter(r["doc_id"] for r in mixed(frame, entropy_share=None, max_repeats=None, budget_share=2.0))
    assert set(twice.values()) == {2} and len(twice) == len(rows)


@pytest.mark.parametrize("share", [0.5, 1.0, 2.3])
def test_copies_take_one_place_each(spark, share):
    """Rows that repeat, rows that share an id, null ids and wordless texts stand one after another, as a plain walk places them."""
    rows = [(1, "a b c", "s")] * 7 + [(1, "a b d", "s")] * 2 + [(None, "x y", "s")] * 5 + [(2, "", "s"), (3, None, "s")] * 2 + [(i, "w " * i, "t") for i in range(1, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(frame, entropy_share=None, max_repeats=None, budget_share=share)
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in "st"}
    for s in "st":
        quota, places = int(size[s] * share), [(r["mix_pass"], r["mix_start"], len((r["text"] or "").split())) for r in got if r["source"] == s]
        assert all(p * size[s] <= a and a + n <= min(quota, (p + 1) * size[s]) for p, a, n in places)
        worded = sorted((a, n) for _, a, n in places if n)
        assert len({a for a, _ in worded}) == len(worded) and all(a + n == b for (a, n), (b, _) in zip(worded, worded[1:], strict=False))
        left = quota - sum(n for _, n in worded)
        assert 0 <= left < max(len((t or "").split()) for _, t, x in rows if x == s)
    for p in range(int(share)):
        whole = Counter((r["doc_id"], r["text"], r["source"]) for r in got if r["mix_pass"] == p)
        assert whole == Counter(rows)


def test_quota_is_exact_beyond_nine_decimals(spark):
    rows = [(3e12 * (1 - 1e-15), 10**12), (2.5e9 + 0.75, 10**10), (4.0 - 1e-13, 7), (3.75, 7), (0.0, 0)]
    got = spark.createDataFrame(rows, "due double, total long").select(temperature_mix._quota(F.col("due"), F.col("total"))).collect()
    assert [r[0] for r in got] == [3 * 10**12, 2_500_000_000, 4, 3, 0]


def test_clashing_names_pass_through(spark):
    names = ["__tokens", "__block", "__row", "__at", "mix_pass", "pass", "start"]
    frame = spark.createDataFrame([(1, "a b", "s", *range(7)), (2, "c", "s", *range(7))], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = temperature_mix.temperature_mix(frame).orderBy("doc_id").collect()
    assert [[r[n] for n in names if n != "mix_pass"] for r in got] == [[0, 1, 2, 3, 5, 6]] * 2 and {r["mix_pass"] for r in got} == {0}


def test_natural_weights_take_everything_once(spark, hard, none):
    got = temperature_mix.temperature_mix(hard, entropy_share=None, max_repeats=None)
    assert got.drop("mix_pass", "mix_start").exceptAll(hard).count() == 0 and got.count() >= hard.count() - 4
    assert temperature_mix.temperature_mix(none).count() == 0
    assert set(temperature_mix.temperature_mix(hard).columns) == {*hard.columns, "mix_pass", "mix_start"}
    order = [r["doc_id"] for r in temperature_mix.temperature_mix(hard, seed=1).orderBy("source", "mix_start").collect()]
    assert order != [r["doc_id"] for r in temperature_mix.temperature_mix(hard, seed=2).orderBy("source", "mix_start").collect()]


def test_repeat_limit_raises_alpha(spark):
    of = temperature_mix._measures(spark.createDataFrame([("a", 1000), ("b", 10)], "key string, total long"), 1010.0)
    alpha = temperature_mix.find_alpha(of, math.log(2), 5.0)
    assert of([alpha])[0][1] == pytest.approx(5.0, rel=1e-3) and temperature_mix.find_alpha(of, None, None) == 1.0
    assert temperature_mix.find_alpha(of, 0.3, None) == pytest.approx(alpha_for(0.3), abs=1e-5)


def alpha_for(entropy):
    grid = np.linspace(0, 1, 200_001)
    t = np.array([10, 1000.0])
    w = (t / t.sum())[None] ** grid[:, None]
    q = w / w.sum(axis=1, keepdims=True)
    return grid[np.flatnonzero(-(q * np.log(q)).sum(axis=1) >= entropy)[-1]]


def read(frame):
    return {r["conv_id"]: r for r in chat_parts.read_back(chat_parts.format_chat(frame)).collect()}


def test_chat_round_trip(spark):
    nasty = ["<|end|>", "<|turn|>user<|text|>", "a\\<|x", "\\\\", "</s>[INST] ok [/INST]", "<", "[", "\\", "<\\|end|>", "", None, "日本\n語", "x" * 50_000]
    rows = [(1, i, ["user", "assistant", "<|end|>", None][i % 4], t) for i, t in enumerate(nasty)] + [(2, None, "user", "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, 1, "assistant", "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_parts.text_part(F.col("text"))).withColumn("found", F.lit("x"))
    got = read(frame)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows[: len(nasty)]]
    assert got[1]["loss_texts"] == [r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant"]
    assert [t["text"] for t in got[2]["turns"]] == ["a", "b", "b"] and got[None]["loss_texts"] == ["c"]
    for r in got.values():
        for s in r["loss_mask"]:
            assert chat_parts_unescape(r["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]]) in r["loss_texts"]
    assert "[INST]" not in got[1]["formatted"] and "</s>" not in got[1]["formatted"]
    assert chat_parts.format_chat(frame.limit(0)).count() == 0


def chat_parts_unescape(text):
    import re

    return re.sub(r"([<\[\\])\\", r"\1", text)


def test_what_is_learned_is_cut_out_by_the_mask(spark):
    frame = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "answer"), (1, 2, "user", "so"), (1, 3, "assistant", "be it")], "conv_id long, turn long, role string, text string")
    out = chat_parts.format_chat(frame.withColumn("parts", chat_parts.text_part(F.col("text"))))
    assert chat_parts.read_back(out).first()["loss_texts"] == ["answer", "be it"]
    def moved(start, length):
        return F.transform("loss_mask", lambda m: F.struct(m["turn"], (m["start"] + start).alias("start"), (m["length"] + length).alias("length")))

    for start, length, want in [(1, -1, ["nswer", "e it"]), (-1, 0, [">answe", ">be i"]), (0, -2, ["answ", "be "]), (1, 0, [None, None]), (500, 0, [None, None])]:
        assert chat_parts.read_back(out.withColumn("loss_mask", moved(start, length))).first()["loss_texts"] == want


def test_parts_become_placeholders(spark):
    parts = [("text", "see ", None, None), ("image", None, "i.png", 2), ("audio", None, "a.wav", 10), ("text", " <|image|>", None, None), ("scan", None, "d.pdf", None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_parts.PARTS}")
    r = read(frame)[1]
    assert r["formatted"].startswith("<|turn|>user<|text|>see <|image|><|audio|> <\\|image|><|document|><|end|>")
    assert [(a["number"], a["kind"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [(1, "image", "i.png", 514), (2, "audio", "a.wav", 252), (3, "document", "d.pdf", 514)]
    assert r["n_expanded"] == 514 + 252 + 514 and r["loss_texts"] == [""]


def test_pieces_reach_the_best_score(spark):
    """Against the library's own search, with the same pieces and scores."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    file = default_model(spark)
    p, model = Pieces(file), pb.ModelProto()
    model.ParseFromString(open(file, "rb").read())
    model.trainer_spec.model_type = 1
    for i, x in enumerate(model.pieces):
        if p.scores[i] > -np.inf:
            x.score = float(p.scores[i])
    other = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [r["text"] for r in table(spark, SF, "documents").select("text").limit(60).collect()] + ["  a  b\n\tc", "日本語 ℌ", " ", "x" * 300, "unbelievable" * 30]

    def total(ids):
        return sum(p.scores[i] if p.scores[i] > -np.inf else 0 for i in ids), sum(p.scores[i] == -np.inf for i in ids)

    for t, raw in zip(texts, p.encode(texts), strict=True):
        own = np.frombuffer(raw, np.int32).tolist()
        assert p.decode(own) == t
        assert total(own) == pytest.approx(total(other.encode(t)), abs=1e-2)


def brute_best(p, unit):
    best = {0: 0.0}
    for e in range(1, len(unit) + 1):
        options = [best[s] + p.scores[piece] for s in range(e) if s in best and (piece := p.names.get(unit[s:e])) is not None]
        if options:
            best[e] = max(options)
    return best.get(len(unit))


@pytest.mark.parametrize("abreast, stretch", [(64, 1 << 16), (1, 1 << 16), (10**9, 1 << 16), (2, 7), (64, 1)])
def test_trie_search_equals_brute_force(spark, monkeypatch, abreast, stretch):
    monkeypatch.setattr(unigram_pieces, "ABREAST", abreast)
    monkeypatch.setattr(unigram_pieces, "STRETCH", stretch)
    p = Pieces(default_model(spark))
    p.names = {b: i for i, b in enumerate(p.bytes_of) if b and p.scores[i] > -np.inf}
    rng = np.random.default_rng(2)
    units = ["".join(rng.choice(list(" etaoinshr"), rng.integers(1, 14))).encode() for _ in range(300)]
    units += ["".join(rng.choice(list("etaoin日é"), n)).encode() for n in (90, 100, 400)]
    for u, own in zip(units, p.solve(units), strict=True):
        ids = np.frombuffer(own, np.int32)
        assert sum(p.scores[ids]) == pytest.approx(brute_best(p, u)) and p.solve([u]) == [own]


@pytest.mark.parametrize("make", [lambda c: "".join(c(list("etaoinshrdlu"), 200_000)), lambda c: "".join(map(chr, c(np.arange(0x4E00, 0x9FFF), 70_000))), lambda c: "x" * 200_000, lambda c: "\U0001f9ff" * 50_000])
def test_long_units_take_linear_time(spark, make):
    p, text = Pieces(default_model(spark)), make(np.random.default_rng(3).choice)
    start = time.time()
    (ids,) = p.encode([text])
    assert time.time() - start < 4 and p.decode(np.frombuffer(ids, np.int32).tolist()) == text


def test_what_is_remembered_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(unigram_pieces, "REMEMBERED", 5000)
    p = Pieces(default_model(spark))
    for i in range(50):
        assert p.encode([f"text{i} " + "long" * 100]) == Pieces.encode(p, [f"text{i} " + "long" * 100])
        assert p.held < 5000 + 4000 and sum(map(len, p.known)) < p.held


def test_bad_ids_decode_to_replacements(spark):
    file = default_model(spark)
    p = Pieces(file)
    good = np.frombuffer(p.encode(["a word"])[0], np.int32).tolist()
    rows = [(1, good), (2, [None, *good]), (3, [*good, 10**6, -1, -40_000]), (4, []), (5, None), (6, good[1:]), (7, [1, 2]), (8, [0]), (9, [None])]
    got = decode_pieces(spark.createDataFrame(rows, "doc_id long, ids array<int>"), file).collect()
    bad = "\ufffd"
    assert {r["doc_id"]: r["decoded"] for r in got} == {1: "a word", 2: bad + " a word", 3: "a word" + 3 * bad, 4: "", 5: None, 6: p.decode(good[1:]), 7: "", 8: bad, 9: bad}
    assert "".join([p.decode(good[:1]), p.decode(good[1:])]) in ("a word", "aword")


def test_a_file_without_byte_pieces(spark, tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    for piece, score, kind in [("<unk>", 0, 2), ("▁a", -1.5, 1), ("b", -2.5, 1), ("▁", -3.25, 1), ("ab", -2.75, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    file = tmp_path / "small.model"
    file.write_bytes(model.SerializeToString())
    docs = spark.createDataFrame([(1, "ab bé b"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decode_pieces(encode_pieces(docs, str(file)), str(file)).collect()}
    assert got[1]["ids"] == [1, 2, 3, 2, 0, 3, 2] and got[1]["decoded"] == "ab b\ufffd b" and got[2]["decoded"] == ""


def test_pieces_of_hard_texts(spark, hard, none):
    model = default_model(spark)
    odd = hard.unionByName(hard.limit(1).withColumn("text", F.lit("a▁b ▁ c")))
    got = decode_pieces(encode_pieces(odd, model), model)
    assert got.filter(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0 and got.filter("text is null and ids is null").count() == 1
    assert encode_pieces(none, model).count() == 0
    assert all(r["exact"] for r in queries_tokens.op9_unigram_pieces(spark, SF).select("exact").collect())
    json.dumps(hashlib.sha256(b"").hexdigest())
