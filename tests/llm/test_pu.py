import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from strandline.llm import pu_quality, queries_quality
from strandline.llm.pu_quality import quality_scores
from strandline.plans.runtime import table


def test_query_on_held_out_labels(spark):
    """Every held-out document gets its label, though bad labels are never read; clean ones all stay."""
    got = queries_quality.op11_pu_quality(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("held_out").collect()
    good, bad = ([r["predicted"] for r in got if r["quality"] == q] for q in (1, 0))
    assert len(good) > 80 and sum(good) >= 0.98 * len(good)
    assert len(bad) > 10 and sum(bad) <= 0.1 * len(bad)


def test_query_has_a_row_for_each_document(spark):
    got = queries_quality.op11_pu_quality(spark, SF)
    assert got.count() == table(spark, SF, "documents").count()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def plain(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
    n = max(1, len(ws))
    near = sum(len(low[i : i + 64]) - len(set(low[i : i + 64])) for i in range(0, len(low), 64))
    triples = [tuple(low[i : i + 3]) for i in range(len(low) - 2)]
    lines = [x for x in text.split("\n") if x]
    sizes = [len(w.encode()) for w in ws]
    return [np.log1p(len(ws)), sum(sizes) / n, float(np.std(sizes)) if sizes else 0.0, near / n, sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, (len(triples) - len(set(triples))) / n,
            (len(lines) - len({re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in lines})) / max(1, len(lines)), np.log1p(len(ws) / max(1, len(lines)))]


def test_features_equal_plain_ones():
    texts = ["a b a b a b c", None, "", " \n ", "One\none\n\nTWO two", "é ü é\tx", "x " * 200, "w1 w2 w3 w1 w2 w3\n" * 40, "Na! $$ (x); \"q\" | 12.5", "last"]
    x, count = pu_quality.features(pa.array(texts, pa.string()))
    assert x.shape == (len(texts), pu_quality.N_FEATURES) and np.isfinite(x).all()
    assert count.tolist() == [len((t or "").split()) for t in texts]
    np.testing.assert_allclose(x[:, -8:], [plain(t or "") for t in texts], atol=1e-5)
    for i, t in enumerate(texts):
        alone, _ = pu_quality.features(pa.array([t], pa.string()))
        np.testing.assert_allclose(alone[0], x[i], atol=1e-6)
    shares = x[texts.index("a b a b a b c")][: pu_quality.N_CLASSES]
    assert shares[0] == pytest.approx(6 / 13) and shares[2] == pytest.approx(7 / 13)


def mixture(seed, n_good, n_any, share, gap):
    rng = np.random.default_rng(seed)
    of_any = rng.random(n_any) < share
    good = np.arange(n_good + n_any) < n_good
    x = rng.normal(size=(n_good + n_any, 6))
    x[:, 0] += np.where(np.concatenate([np.ones(n_good, bool), of_any]), gap, -gap)
    return x.astype(np.float32), good, of_any


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_of_a_known_mixture(share):
    x, good, of_any = mixture(1, 2000, 4000, share, 2.5)
    assert abs(pu_quality.class_prior(x, good) - share) < 0.05
    net, _ = pu_quality.train(x, good)
    test, _, truth = mixture(2, 0, 2000, share, 2.5)
    assert ((net.margin(test) >= 0) == truth).mean() > 0.97


def test_slopes_are_derivatives_of_the_risk():
    rng = np.random.default_rng(3)
    good = rng.random(40) < 0.4
    for prior, shift in ((0.3, 0.0), (0.9, -3.0)):  # with the second the negative part is clipped
        f = rng.normal(size=40) + np.where(good, 0, shift)

        def bad_risk(f, prior=prior):
            return np.logaddexp(0, f)[~good].mean() - prior * np.logaddexp(0, f)[good].mean()

        def risk(f, prior=prior, bad_risk=bad_risk):
            return prior * np.logaddexp(0, -f)[good].mean() + bad_risk(f)

        clipped = bad_risk(f) < 0
        assert clipped == (shift < 0)
        of = (lambda v, bad_risk=bad_risk: -bad_risk(v)) if clipped else risk
        slopes = pu_quality.non_negative_slopes(good, prior)(f)
        for i in range(0, 40, 7):
            step = np.zeros(40)
            step[i] = 1e-5
            assert slopes[i] == pytest.approx((of(f + step) - of(f - step)) / 2e-5, abs=1e-6)


def test_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, "x") for i in range(60)] + [(None, 1, "x"), (3, None, "x"), (10**6, 1, "x"), (4, 0, "x"), (4, 1, "x")], "doc_id long, quality int, text string")
    every = lambda i: F.lit(True)
    got = quality_scores(hard, labels, every, keep=["doc_id", "text", "id"]).collect()
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if not (r["text"] or "").strip(" \t\n"))
    assert len({r["score"] for r in got if r["doc_id"] == 11}) == 1
    assert quality_scores(none, labels, every).count() == 0
    for nothing in (quality_scores(hard, labels.limit(0), every), quality_scores(hard, labels, lambda i: F.lit(False))):
        assert {r["score"] for r in nothing.collect()} == {0.0, 0.5}


def test_repeated_ids_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, f"word {i} and more words", "b") for i in range(300)], "doc_id long, text string, id string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    x, good = pu_quality.training_rows(docs.select(F.col("doc_id").alias("id"), "text"), labels.toDF("id", "label"), lambda i: F.lit(True), 20, 50)
    assert len(x) == 70 and good.sum() == 20
