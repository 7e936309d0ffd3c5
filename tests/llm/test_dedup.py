import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from strandline.llm import minhash_bayes, queries_dedup, suffix_levels
from strandline.llm.components import connected_components, extended_components
from strandline.plans.runtime import table


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute_classes(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    least, where = {i: i for i in sets}, {}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in where.get(s, ()))
        for s in sets[i]:
            where.setdefault(s, []).append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "rows", "block", "fan"), [(3, 85, 8, 2048, 512), (5, 80, 7, 3, 2)])
def test_classes_equal_brute_force(spark, hard, k, percent, rows, block, fan):
    """The last case deals buckets into blocks, and the members of hubs over tasks."""
    got = minhash_bayes.near_duplicate_classes(hard, shingle_words=k, percent=percent, rows=rows, block=block, fan=fan).collect()
    assert len(got) == hard.count()
    want = brute_classes([(r["doc_id"], r["text"]) for r in hard.filter("doc_id is not null").collect()], k, percent)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    loose = [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None]
    assert sorted(loose, key=str) == [(11, False), (None, True)]


def near_copies(n):
    """Texts of 60 words with one or two own words each: some pairs reach 0.85 on three-word shingles, most do not."""
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        ws = list(base)
        for place in ((7 * i) % 60, (11 * i + 3) % 60)[: 1 + i % 2]:
            ws[place] = f"own{i}x{place}"
        out.append((i, " ".join(ws)))
    return out


@pytest.mark.parametrize(("block", "block_bytes"), [(2048, 8 << 20), (7, 8 << 20), (2048, 2000)])
def test_near_copies_around_the_threshold_equal_brute_force(spark, block, block_bytes):
    """Blocks by number and by bytes give the same classes; a class does not depend on which of its pairs were compared."""
    rows = near_copies(120) + [(1000 + i, " ".join(f"v{(i // 3) * 50 + j}" for j in range(40))) for i in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows, 3, 85)
    got = minhash_bayes.near_duplicate_classes(frame, shingle_words=3, percent=85, rows=8, block=block, block_bytes=block_bytes).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_blocks_give_a_forest_of_links():
    """Forty sets that are all linked, in one bucket: 39 links leave the task, not 780; between equal labels none."""
    n, percent = 40, 85
    sets = [np.sort(np.append(minhash_bayes.mix(np.arange(300, dtype=np.uint64)), np.uint64(i))) for i in range(n)]
    values = minhash_bayes.minhash(sets, 32, 1)
    bands = np.ones((n, 4), np.int64)
    bounds = minhash_bayes.Bounds(percent, 32, 1e-5)

    def batch(labels, own):
        columns = {
            "task": pa.array([1] * n, pa.int64()),
            "node": pa.array(range(n), pa.int64()),
            "label": pa.array(labels, pa.int64()),
            "own": pa.array(own, pa.int32()),
            "bucket": pa.array([1] * n, pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "signature": pa.array([v.astype(np.uint16).tobytes() for v in values], pa.binary()),
            "bands": pa.array(bands.tolist(), pa.list_(pa.int64())),
            "set": pa.array([s.tobytes() for s in sets], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def links(labels, own=(0,) * n):
        return [pair for b in minhash_bayes._blocks_linked(bounds, percent)(iter([batch(labels, own)])) for pair in zip(*b.to_pydict().values(), strict=True)]

    assert len(links(range(n))) == n - 1 == len({u for u, _ in links(range(n))})
    assert not links([5] * n)
    assert len(links([i % 3 for i in range(n)])) == 2
    assert len(links(range(n), [i % 2 for i in range(n)])) == n - 1
    kept = pa.Table.from_batches(minhash_bayes._blocks_kept(bounds)(iter([batch(range(n), (0,) * n)])))
    assert kept.column("node").to_pylist() == list(range(n))


def test_query_equals_brute_force(spark):
    want = brute_classes([tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()], 3, 85)
    for r in queries_dedup.op1_minhash_bayes(spark, SF).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_one_of_each_class_stays(hard, none):
    kept = minhash_bayes.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = brute_classes([(r["doc_id"], r["text"]) for r in hard.filter("doc_id is not null").collect()], 5, 80)
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()})
    assert minhash_bayes.near_duplicate_classes(none).count() == 0 and minhash_bayes.drop_near_duplicates(none).count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    from conftest import edited, words

    x, y = words(1, 80), words(2, 80)
    rows = [(5, x), (5, y), (12, edited(y, 1, 1)), (12, edited(y, 1, 1)), (None, x), (None, words(3, 80)), (7, " "), (7, " ")]
    kept = minhash_bayes.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([rows[0], rows[1], rows[5], rows[6], rows[7]])


def test_chains_and_bridges_are_found(spark):
    """Classes that hang together only by members which are no hubs."""
    from conftest import words

    base = [f"t{i}" for i in range(100)]
    rows = []
    for step in range(12):
        rows += [(100 * step + c, " ".join([*[f"n{step}x{i}" for i in range(3 * step)], *base[3 * step :], f"c{c}"])) for c in range(5)]
    rows += [(5000 + i, words(i, 60)) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows, 3, 85)
    for block in (2, 2048):
        got = minhash_bayes.near_duplicate_classes(frame, shingle_words=3, percent=85, rows=8, block=block, fan=3).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_bands_and_bounds():
    assert 1 - (1 - 0.85**8) ** minhash_bayes.bands_for(85, 8, 1e-5) >= 1 - 1e-5
    least = minhash_bayes.least_matches(85, 64, 1e-5)
    tail = sum(math.comb(33, m) * 0.85**m * 0.15 ** (33 - m) for m in range(least[0]))
    assert tail < 1e-5 <= tail + math.comb(33, least[0]) * 0.85 ** least[0] * 0.15 ** (33 - least[0])
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 2**63, 150).astype(np.uint64)])
    s = minhash_bayes.minhash([a, b], 4000, 5)
    assert abs((s[0] == s[1]).mean() - 850 / 1150) < 0.03


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_extended_components_equal_those_of_all_edges(spark):
    """New edges join components, leave some alone, reach new nodes, repeat and loop."""
    old = [(2, 1), (3, 2), (11, 10), (12, 10), (21, 20)]
    new = [(12, 3), (30, 21), (31, 30), (12, 3), (2, 3), (41, 40), (50, 50)]
    edges = "u long, v long"
    labels = connected_components(spark.createDataFrame(old, edges))
    got = sorted(map(tuple, extended_components(labels, spark.createDataFrame(new, edges)).collect()))
    want = sorted(map(tuple, connected_components(spark.createDataFrame(old + new, edges)).collect()))
    assert got == want
    assert dict(got) == {n: 1 for n in (1, 2, 3, 10, 11, 12)} | {n: 20 for n in (20, 21, 30, 31)} | {40: 40, 41: 40}
    assert sorted(map(tuple, extended_components(labels, spark.createDataFrame([], edges)).collect())) == sorted(map(tuple, labels.collect()))


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = len(re.findall(b"\1+", bytes(mark)))
        yield len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()


def removed(frame):
    return frame.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0), lambda a, s: a + s["stop"] - s["start"]).alias("r"), F.size("spans").alias("n"), "kept_sha256"
    ).collect()


@pytest.mark.parametrize(("batches", "part_bytes"), [(1, 6 << 20), (3, 2000), (8, 6 << 20)])
def test_repeats_equal_brute_force(hard, none, batches, part_bytes):
    """With a low bound, the windows of frequent anchors are dealt one by one."""
    rows = hard.collect()
    got = Counter(tuple(r) for r in removed(suffix_levels.remove_repeats(hard, batches=batches, part_bytes=part_bytes, shard_bytes=20_000)))
    want = Counter((r["doc_id"], *w) for r, w in zip(rows, brute_repeats([r["text"] for r in rows], 200), strict=True))
    assert got == want
    assert suffix_levels.remove_repeats(none).count() == 0


def test_very_long_texts_are_read_in_pieces(spark, monkeypatch):
    from conftest import words

    long = words(5, 4000, 900)
    texts = [long, "x" + long[3000:9000] + "y", words(6, 300, 900) + long[-450:], long[:700].replace("w1", "w2")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = suffix_levels.anchored_runs(*suffix_levels.bytes_of(pa.array([long])), 200)
    monkeypatch.setattr(suffix_levels, "PIECE", 1000)
    data, offsets = suffix_levels.bytes_of(pa.array([long]))
    covered = np.zeros((2, len(data)), np.int64)
    for _, key, lo, hi, at in zip(*runs, strict=True):
        covered[0, lo : hi + 1] = key + at
    for shift, piece, ends in suffix_levels.pieces_of(data, offsets, 200):
        for _, key, lo, hi, at in zip(*suffix_levels.anchored_runs(piece, ends, 200), strict=True):
            covered[1, lo + shift : hi + shift + 1] = key + at + shift
    assert (covered[0] == covered[1]).all()
    got = {r["doc_id"]: tuple(r)[1:] for r in removed(suffix_levels.remove_repeats(frame))}
    assert got == dict(enumerate(brute_repeats(texts, 200)))


def test_repeat_query_equals_brute_force(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, brute_repeats([r["text"] for r in rows], 200), strict=True)}
    for r in queries_dedup.op4_suffix_levels(spark, SF).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_levels_grow_geometrically(spark):
    rng, index, seen = np.random.default_rng(1), suffix_levels.SuffixIndex(200), Counter()
    for batch in range(13):
        keys = [int(k) for k in rng.integers(0, 3000, 200)]
        got = {r["key"]: r["size"] for r in index.add(spark.createDataFrame([(k, 5, 9) for k in keys], "key long, lo int, hi int")).collect()}
        seen.update(keys)
        assert got == {k: 204 * seen[k] for k in set(keys) if seen[k] > 1}, batch
    assert [a for a, _ in index.levels] == [3, 2, 0]  # thirteen batches: 8 + 4 + 1
    rows = [tuple(r) for _, level in index.levels for r in level.select("key", "n").collect()]
    total = Counter()
    for k, n in rows:
        total[k] += n
    assert total == seen
    index.close()


def test_windows_by_suffixes_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(40):
        core = bytes(rng.integers(97, 99, 32, dtype=np.uint8))
        rows = []
        for i in range(30):
            far, after = int(rng.integers(0, 169)), int(rng.integers(0, 169))
            text = bytes(rng.integers(97, 99, 3, dtype=np.uint8)).rjust(far, b"x")[-far:] if far else b""
            text += core + bytes(rng.integers(97, 98 + i % 2, after, dtype=np.uint8)) + b"z" * max(0, 168 - far - after)
            rows.append((i % 2, b"k" * 16, 0, far, max(0, min(far, len(text) - 200)), text, False))
        names = ["grp", "text_key", "lo", "at", "hi", "bytes", "sure"]
        table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
        windows = Counter((r[0], r[3] - s, r[5][s : s + 200]) for r in rows for s in range(r[4] + 1))
        want = [(i, s) for i, r in enumerate(rows) for s in range(r[4] + 1) if windows[r[0], r[3] - s, r[5][s : s + 200]] > 1]
        row, start = suffix_levels.repeated_windows(table, 200)
        assert list(zip(row.tolist(), start.tolist(), strict=True)) == want
