import hashlib
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from oracle import SF, check
from pyspark.sql import functions as F

from strandline.llm import byte_gru, host_rules, pii_bootstrap, queries_quality
from strandline.plans.runtime import table


def test_rules_equal_sql(spark):
    check(spark, "op8", queries_quality.op8_host_rules, queries_quality.HOST_RULES_SQL)


def brute_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    covered, times = set(), Counter(windows)
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_on_hard_texts(spark, hard, none):
    extra = ["v w " * 60_000, "a b c d e f g h i " * 3, "x\ny\nx\n \n\nx", "# * a\tb\x0bc\x0cd", "一 二 三"]
    rows = hard.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(900 + i, t, "z") for i, t in enumerate(extra)], "doc_id long, text string, source string"))
    got = {r["doc_id"]: r for r in host_rules.host_verdicts(rows).collect()}
    for r in rows.collect():
        g = got[r["doc_id"]]
        if r["doc_id"] is not None:
            assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == brute_counts(r["text"])
            assert g["base_failed"] == (g["n_words"] < 20 or 100 * g["n_repeat_words"] > 30 * g["n_words"])
            assert not (g["base_failed"] and g["kept"])
    assert host_rules.host_verdicts(none).count() == 0


def test_bad_hosts_go_with_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good + f" {i}", "clean") for i in range(50)] + [(100 + i, "spam", "bad") for i in range(49)] + [(200, good, "bad"), (201, good, "new")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in host_rules.host_verdicts(frame).collect()}
    assert all(kept[i] for i in range(50)) and not kept[200] and kept[201]
    assert sorted(r["doc_id"] for r in host_rules.passing(frame).collect()) == sorted(i for i, k in kept.items() if k)
    clash = frame.selectExpr("doc_id", "text", "source", "1 as row", "2 as host_key", "3 as __counts", "4 as n_words")
    assert {tuple(r)[3:] for r in host_rules.passing(clash).collect()} == {(1, 2, 3, 4)} and host_rules.passing(clash).columns == clash.columns


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card" and (not 14 <= len(digits) <= 19 or sum(x - 9 * (x > 9) for x in twice) % 10):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_regular_expressions():
    rng = np.random.default_rng(5)
    texts = ["a@b.c@d.e", "a@b.c_x@d.e", "@a.b", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 01.02.03.0004", "4111 1111 1111 1111", "+1 (017) 555-7713.", "é@b.co ümail@x.de", "a@@b.c", "..@-.-"]
    texts += ["".join(rng.choice(list("aé1290.@-+ ()_\n"), 60)) for _ in range(2000)]
    for t in texts:
        assert pii_bootstrap.base_spans(t) == brute_spans(t), t


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    for r in queries_quality.op7_pii_bootstrap(spark, SF).collect():
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_patterns_find_unseen_identifiers(spark, hard, none):
    rows = [(i, f"please mail me u{i}@x.com or call today") for i in range(5)] + [(10, "kindly mail me someone#99123 today"), (11, "the number 20240101 of words")]
    rows += [(20 + i, "the number of words in the number of lines") for i in range(9)] + [(30 + i, f"see the number 10.0.0.{i} here") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii_bootstrap.personal_data(frame).collect()}
    text = rows[5][1]
    assert got[10] == [(text.index("someone"), 4, "id", text.index(" today"))]
    assert got[11] == []  # its pattern mostly stands before other words
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redact(frame).collect()}
    assert clean[10] == "kindly mail me [ID] today" and clean[0] == "please mail me [EMAIL] or call today" and clean[20] == rows[7][1]
    same = pii_bootstrap.redact(hard)
    assert same.columns == hard.columns and same.exceptAll(hard).count() == 0
    assert pii_bootstrap.personal_data(none).count() == 0 and pii_bootstrap.redact(none).count() == 0


def test_labels_glued_to_identifiers(spark):
    forms = ["my tel:{} now", "our id={} now", "the contact <{}> now", "a contact ({}) now", 'set token = "{}" now']
    seeds = ["+1 (017) 555-77{}3", "10.0.0.{}", "u{}@x.com", "u{}@x.com", "v{}@x.com"]
    rows = [(10 * k + i, form.format(seed.format(i))) for k, (form, seed) in enumerate(zip(forms, seeds, strict=True)) for i in range(4)]
    unseen = [form.format("9abc123") for form in forms]
    rows += [(100 + k, t) for k, t in enumerate(unseen)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii_bootstrap.personal_data(frame).collect()}
    for k, t in enumerate(unseen):
        assert any(s["kind"] == "id" and t[s["start"] : s["stop"]].endswith("9abc123") for s in got[100 + k]), t
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redact(frame).collect()}
    assert clean[101] == "our id=[ID] now" and clean[102] == "the contact <[ID]> now" and clean[104] == 'set token = "[ID]" now'


def test_patterns_are_counted_where_they_are_taken():
    rng = np.random.default_rng(8)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab1 2@.+:=\"( )"), 40)) + "z" * int(rng.integers(0, 50)) + " 4.4.4.4 x1234"
        places = pii_bootstrap.patterns_of(pii_bootstrap._TOKEN.findall(pii_bootstrap.folded(text)))
        every = {p for place in places for p in pii_bootstrap.named(*place)}
        for c in pii_bootstrap.candidates(text, pii_bootstrap.base_spans(text)):
            assert set(c["patterns"]) <= every, (text, c)


def brute_added(texts, rounds=60, min_score=0.5, min_support=3):
    """Spans added to each text, by counting and scoring everything in dictionaries, in far more rounds than are needed."""
    total, edges, beliefs, places = Counter(), Counter(), {}, []
    for k, t in enumerate(texts):
        for place in pii_bootstrap.patterns_of(pii_bootstrap._TOKEN.findall(pii_bootstrap.folded(t))):
            total.update(pii_bootstrap.named(*place))
        for c in pii_bootstrap.candidates(t, pii_bootstrap.base_spans(t)):
            places.append((k, c))
            for p in c["patterns"]:
                edges[p, c["value"]] += 1
            if c["patterns"]:
                beliefs[c["value"]] = max(beliefs.get(c["value"], 0.0), float(c["seed"]))
    seeds, trusted = dict(beliefs), {}
    for _ in range(rounds):
        score, support, doubtful = Counter(), Counter(), Counter()
        for (p, v), n in edges.items():
            score[p] += beliefs[v] * n
            doubtful[p] += (1 - beliefs[v]) * n
            support[p] += beliefs[v] >= min_score
        score = {p: s / max(s, total[p] - 0.75 * doubtful[p]) for p, s in score.items() if s}
        trusted = {p: s for p, s in score.items() if s >= min_score and support[p] >= min_support}
        doubt = {}
        for p, v in edges:
            if p in trusted:
                doubt[v] = doubt.get(v, 1.0) * (1 - min(trusted[p], 0.999999))
        beliefs = {v: max(b, 1 - doubt.get(v, 1.0)) for v, b in seeds.items()}
    return {(k, c["start"], c["stop"]) for k, c in places if not c["base"] and set(c["patterns"]) & set(trusted)}


def test_graph_equals_brute_force(spark):
    """A planted corpus: labels in brackets, quotes and key=value, of which some name identifiers and others anything."""
    rng = np.random.default_rng(4)
    forms = ["mail me {} today", "user ({}) left", 'set key = "{}" now', "id={};", "the number {} of", "see <{}> for more", "call tel:{} soon", "note: {} and so on"]
    seeds = ["u{}@x.com", "10.0.{}.7", "+1 (017) 555-77{}3", "{:040x}"]
    texts = []
    for i in range(600):
        form = forms[int(rng.integers(len(forms)))]
        kind = int(rng.integers(7))
        inner = seeds[kind].format(int(rng.integers(10, 99)) if kind < 3 else int(rng.integers(1 << 60)) << 90) if kind < 4 else f"x{rng.integers(10**6)}" if kind == 4 else ["plain", "words"][kind - 5]
        texts.append(f"w{rng.integers(50)} " + form.format("plain" if form.startswith("the") and i % 3 else inner))
    texts += ["long " + "y" * 500 + " " + f"u{i}@x.com" for i in range(4)] + ["long " + "y" * 500 + " " + "1" * 300 + tail for tail in "ab"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], s["start"], s["stop"]) for r in pii_bootstrap.personal_data(frame).collect() for s in r["spans"] if s["kind"] == "id"}
    assert got == brute_added(texts) and len(got) > 30
    assert {(604, 506, 807), (605, 506, 807)} <= got  # words of any length count, and values that differ late are two
    named = [k for k, t in enumerate(texts) if 'key = "x' in t or "(x" in t or "mail me x" in t]
    assert len({k for k, _, _ in got} & set(named)) == len(named)


def found_ids(spark, texts, partitions=4):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    return {(r["doc_id"], r["s"]["start"], r["s"]["stop"]) for r in pii_bootstrap.personal_data(frame).selectExpr("doc_id", "explode(spans) as s").filter("s.kind = 'id'").collect()}


def test_rounds_go_on_until_nothing_changes(spark):
    """Each context is trusted only by what the one before it names; the last of six is far beyond three rounds."""
    texts = [f"w{i} alpha0 beta0 u{i}@x.com" for i in range(4)] + [f"w{i} alpha0 beta0 x{i}-0-1234" for i in range(4)]
    for k in range(1, 7):
        texts += 2 * [f"w{i} alpha{'abcdefg'[k]} beta{'abcdefg'[k]} x{i}-{k - 1}-1234" for i in range(4)]
        texts += [f"w{i} alpha{'abcdefg'[k]} beta{'abcdefg'[k]} x{i}-{k}-1234" for i in range(4)]
    got = found_ids(spark, texts)
    assert got == brute_added(texts)
    assert {k for k, _, _ in got} == set(range(4, len(texts)))
    assert len(brute_added(texts, rounds=3)) < len(got)


def test_recall_of_identifiers_that_are_no_seeds(spark):
    """Six kinds of labels over many texts; two thirds of the identifiers have forms that no base pattern and no key has."""
    rng = np.random.default_rng(12)
    labels = ["patient no. {} was seen", "badge ({}) issued", "member: {} joined", "case id={} closed", "write to {} soon", "ref <{}> filed"]
    unseen = ["MRN-{:06d}", "{:05d}/B", "Z{:04d}Q", "kp#{:07d}"]
    base = ["u{}@mail.org", "10.1.{}.9", "+49 (30) 555-{:05d}"]
    texts, planted = [], set()
    for i in range(900):
        noise = " ".join(f"n{'abcdefghij'[j]}" for j in rng.integers(0, 10, 8))
        form = labels[int(rng.integers(len(labels)))]
        if rng.random() < 0.35:
            k = int(rng.integers(3))
            value = base[k].format(int(rng.integers(10, 99)) if k < 2 else int(rng.integers(10**5)))
        else:
            value = unseen[int(rng.integers(4))].format(int(rng.integers(10**4)))
            start = len(noise) + 1 + form.index("{")
            planted.add((i, start, start + len(value)))
        texts.append(f"{noise} {form.format(value)} {noise}")
    texts += [f"in the year {1900 + i} there were {1000 + i} of them" for i in range(100)]
    got = found_ids(spark, texts)
    assert len(got & planted) >= 0.9 * len(planted)
    assert len(got - planted) <= 0.02 * len(got)


@pytest.mark.parametrize("piece", ["1.1.1.1,", "a@b.c ", ":::\"", "x1234 ", "+1 (017) 555-7713;", "1" * 64, "é\u2028<"])
def test_long_texts_take_linear_time(piece):
    import time

    text = piece * (1_000_000 // len(piece))
    start = time.time()
    spans = pii_bootstrap.base_spans(text)
    pii_bootstrap.candidates(text, spans)
    list(pii_bootstrap.patterns_of(pii_bootstrap._TOKEN.findall(pii_bootstrap.folded(text))))
    assert time.time() - start < 5


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = byte_gru.ByteGRU(3, 4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, mask, y = rng.integers(97, 105, (7, 5)).astype(np.uint8), np.ones((7, 5), np.float32), np.array([0, 1, 2, 1, 0])
    mask[5:, 2] = 0
    _, grads = net.gradients(x, mask, y)
    for k, g in grads.items():
        at = (99, 2) if k[0] == "x" else tuple(s // 2 for s in g.shape)
        own = net.weights[k][at]
        sides = []
        for step in (1e-5, -1e-5):
            net.weights[k][at] = own + step
            sides.append(net.gradients(x, mask, y)[0])
        net.weights[k][at] = own
        assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-8)
    net.weights = {k: v.astype(np.float32) for k, v in net.weights.items()}
    states = {d: np.stack([s[5] for s in net._forward(x, mask, d)]) for d in "fb"}
    logits = states["f"] @ net.weights["vf"] + states["b"] @ net.weights["vb"]
    want = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    assert np.allclose(net.positions(x, mask), want.transpose(0, 2, 1), atol=1e-5)


def test_languages_held_out(spark):
    rows = queries_quality.op6_byte_gru(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_copies_do_not_crowd_out_a_sample(spark):
    rows = [("en", f"copy number {i % 3}") for i in range(5000)] + [("de", f"wort {i} satz") for i in range(600)] + [("fr", None), ("fr", "123")]
    got = byte_gru.training_windows(spark.createDataFrame(rows, "lang string, text string"), 50, 4, 1000)
    assert Counter(k for k, _ in got) == {"en": 3, "de": 50} and len(set(got)) == 53
    long = " ".join(f"word{i}" for i in range(100))
    assert {w for _, w in byte_gru.training_windows(spark.createDataFrame([("en", long)], "lang string, text string"), 50, 4, 1000)} == {
        long.encode()[k * ((len(long) - 64) // 3) :][:64] for k in range(4)
    }


def brute_probabilities(net, text):
    """Position by position, in plain loops, over the windows of one text."""
    raw, total, weight = text.encode(), np.zeros(net.n_classes), 0.0
    for a in range(0, len(raw), byte_gru.WIDTH):
        part = raw[a : a + byte_gru.WIDTH]
        states = {}
        for d in "fb":
            h, w = np.zeros(net.hidden), {k: net.weights[k + d].astype(float) for k in "xuv"}
            for t in range(len(part)) if d == "f" else reversed(range(len(part))):
                g, u, n = w["x"][part[t]], h @ w["u"], net.hidden
                r, z = 1 / (1 + np.exp(-g[:n] - u[:n])), 1 / (1 + np.exp(-g[n : 2 * n] - u[n : 2 * n]))
                h = z * h + (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :])
                states[d, t] = h @ w["v"]
        for t, b in enumerate(part):
            if b >= 128 or chr(b).isalpha():
                e = np.exp(states["f", t] + states["b", t] + net.weights["c"])
                total, weight = total + e / e.sum(), weight + 1
    return total / weight


def test_predictions_equal_plain_loops(spark):
    docs = table(spark, SF, "documents").filter("length(text) < 4000").limit(60)
    sample = byte_gru.training_windows(docs.select("lang", "text"), 400, 4, 1000)
    langs, net = byte_gru.train(sample)
    got = {r["doc_id"]: r for r in byte_gru.identify(docs, F.lit(True), keep=["doc_id"]).collect()}
    for r in docs.collect():
        if any(unicodedata.category(c).startswith("L") for c in r["text"] or ""):
            p = brute_probabilities(net, r["text"])
            assert got[r["doc_id"]]["score"] == pytest.approx(p.max(), abs=2e-3) and (got[r["doc_id"]]["lang_pred"] == langs[p.argmax()] or np.ptp(np.sort(p)[-2:]) < 4e-3)
        else:
            assert got[r["doc_id"]]["lang_pred"] == "und"


def test_languages_of_odd_texts(spark, hard, none):
    got = byte_gru.identify(hard, F.lit(True), keep=["doc_id"], epochs=1).collect()
    assert len(got) == hard.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 7, 8)} <= {"en", "de"}
    assert byte_gru.identify(none, F.lit(True), keep=["doc_id"]).count() == 0
    json.dumps([r["score"] for r in got])


def test_numerals_are_no_letters(spark, hard):
    rows = hard.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(900, "½ ² ① 12 _", "en"), (901, "½ a", "en"), (902, "ª", "en")], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in byte_gru.identify(rows, F.lit(True), keep=["doc_id"], epochs=1).collect()}
    assert got[900] == ("und", 0.0) and got[901][0] != "und" != got[902][0]
    nothing = byte_gru.identify(hard, F.lit(False), keep=["doc_id"]).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_passing_writes_counts_only(spark):
    from pathlib import Path

    from strandline.plans.runtime import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "strandline"
    before = set(folder.glob("*"))
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(500)), "a") for i in range(50)], "doc_id long, text string, source string")
    assert host_rules.passing(rows).count() == 50
    assert sum(f.stat().st_size for d in set(folder.glob("*")) - before for f in d.glob("*.parquet")) < 20_000
