import hashlib
import time

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from strandline.llm import queries_search, rotated_bits
from strandline.llm.rotated_bits import hard_negatives
from strandline.llm.shallot_means import Centroids, shallot_means


@pytest.mark.parametrize("name", ["op12_rotated_bits", "op13_shallot_means"])
def test_query_equals_sql(spark, name):
    check(spark, name, queries_search.QUERIES[name], queries_search.ORACLE_SQL[name])


SCHEMA = "vec_id long, label int, embedding array<double>, ids string, block string, task string, best string"
ODD = [None, [], [1.0], [float("nan")] * 64, [float("inf")] * 64, [None] * 64]


def clustered(seed, n, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = [(i, int(i % 4), (centres[i % 6] * 0.3 + rng.normal(size=dims) * 0.1 * (i % 3)).tolist()) for i in range(n)]
    return out + [out[0], out[100], (None, 1, out[3][2]), (100, 3, out[5][2]), *[(1000 + i, 1, v) for i, v in enumerate(ODD)], (2000, None, out[4][2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def plain_means(rows, k, rounds):
    kept = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, _, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all()]
    starts = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", x.tolist()) for i, x in kept)[:k]
    x, c = np.stack([v for _, v in kept]), np.array([s[2] for s in starts])
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        of = d.argmin(axis=1)
        if r < rounds:
            c = np.stack([x[of == j].sum(axis=0) // (of == j).sum() if (of == j).any() else c[j] for j in range(len(c))])
    total = d.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, j)).encode()).hexdigest() for j in c]
    return sorted((str(i), int(o), int(t), int(total[of == o].sum()), int(total.sum()), digest[o]) for (i, _), o, t in zip(kept, of, total, strict=True))


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (1, 2), (40, 6)])
def test_means_equal_plain_rounds(spark, k, rounds):
    rows = clustered(5, 700)
    work = {}
    got = shallot_means(frame(spark, rows), k=k, rounds=rounds, block=64, work=work).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_means(rows, k, rounds)
    assert sum(work.values()) < 0.7 * 700 * k * len(work)


def test_means_of_few_and_equal_vectors(spark):
    same = [(i, 0, [0.5] * 64) for i in range(20)]
    got = shallot_means(frame(spark, same)).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)} and len(got) == 20
    few = [(1, 0, [0.5] * 64), (2, 0, [-0.5] * 64)]
    assert {r["vec_id"]: r["distance"] for r in shallot_means(frame(spark, few)).collect()} == {1: 0, 2: 0}
    none = shallot_means(frame(spark, few).limit(0))
    assert none.count() == 0 and none.columns == shallot_means(frame(spark, few)).columns
    with pytest.raises(Exception, match="64 bits"):
        shallot_means(frame(spark, [(1, 0, [1e9] * 64)])).collect()


def test_search_skips_centroids_and_keeps_ties():
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.integers(-50, 50, (30, 4)), np.zeros((2, 4), int)])
    x = rng.integers(-60, 60, (500, 4))
    best, second, upper, lower = np.zeros(500, np.int32), np.ones(500, np.int32), np.full(500, np.inf), np.zeros(500)
    before = None
    for _ in range(5):
        measured = Centroids(c, before).assign(x, best, second, upper, lower)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all() and measured < d.size
        rest = np.where(np.arange(len(c)) == best[:, None], np.iinfo(int).max, d).min(axis=1)
        assert (upper >= np.sqrt(d.min(axis=1))).all() and (lower <= np.sqrt(rest)).all()
        before, c = c, c + rng.integers(-4, 5, c.shape)


def test_intervals_hold_the_product():
    rng = np.random.default_rng(2)
    for dims in (3, 64, 100):
        x, q = rng.integers(-400, 400, (200, dims)), rng.integers(-400, 400, (7, dims))
        anchors = rotated_bits.Anchors(q)
        intervals = rotated_bits.Intervals(anchors, *rotated_bits.encode(x, 3))
        true, widths = q @ x.T, []

        def wanted(i, lower, upper, true=true, widths=widths):
            if lower.ndim == 2:
                assert (lower <= true).all() and (true <= upper).all()
            widths.append(float((upper - lower).mean()))
            return np.ones(lower.shape, bool)

        i, j = intervals.survivors(np.arange(7), np.ones((7, 200), bool), wanted)
        assert len(i) == 1400 and widths[0] > widths[1] > widths[2]
        # what the last level says of each pair holds, too
        last = []
        intervals.survivors(np.arange(7), np.ones((7, 200), bool), lambda i, lo, up: last.append((lo, up)) or np.ones(lo.shape, bool))
        assert (last[-1][0] <= true[i, j]).all() and (true[i, j] <= last[-1][1]).all()


def plain_negatives(rows, positives, negatives):
    kept = [(i, c, np.floor(256 * np.array(v)).astype(int)) for i, c, v in rows if None not in (i, c) and v and None not in v and np.isfinite(v).all()]
    out = []
    for anchor, own, q in {(i, c, tuple(v.tolist())) for i, c, v in kept if i % 100 == 0}:
        scored = [(-int(v @ np.array(q)), i, c) for i, c, v in kept if i != anchor and len(v) == len(q)]
        for score, positive, _ in sorted(s for s in scored if s[2] == own)[:positives]:
            near = sorted((s, i) for s, i, c in scored if c != own and -30 * score <= -100 * s <= -90 * score)[:negatives]
            out += [(anchor, positive, n + 1, i, -score, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("positives", "negatives", "dims"), [(5, 10, 64), (2, 3, 70)])
def test_negatives_equal_brute_force(spark, positives, negatives, dims):
    rows = clustered(9, 600, dims) + [(700, 2, [0.25, 0.5]), (701, 2, [0.5, 0.5]), (702, 1, [0.5, 0.25]), (800, 1, [0.0] * dims)]
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0, positives=positives, negatives=negatives, anchor_block=3, block=50)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, positives, negatives)


def test_best_looks_at_no_other_groups():
    groups, k = 40_000, 10
    rng = np.random.default_rng(3)
    best = rotated_bits.Best(groups, k)
    best.add(np.repeat(np.arange(groups), k), np.tile(np.arange(k), groups), np.arange(groups * k))
    rows = [(int(s), i) for i, s in enumerate(rng.integers(-5, 12, 3000))]
    begun = time.perf_counter()
    for a in range(0, len(rows), 20):
        best.add(np.full(20, 7), np.array([s for s, _ in rows[a : a + 20]]), np.array([-i for _, i in rows[a : a + 20]]))
    assert time.perf_counter() - begun < 3
    # the tenth of the best stands last, and other groups are as they were
    assert best.least[7] == sorted([*range(k), *[s for s, _ in rows]])[-k] and (np.delete(best.least, 7) == 0).all()


def test_negatives_of_nothing(spark):
    rows = frame(spark, clustered(1, 120))
    assert hard_negatives(rows, F.lit(False)).count() == 0
    assert hard_negatives(rows.limit(0), F.lit(True)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives(frame(spark, [(0, 1, [1e6] * 64), (1, 1, [1e6] * 64)]), F.lit(True)).collect()
