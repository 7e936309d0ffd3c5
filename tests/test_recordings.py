import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import dsp, waveforms
from strandline.operators import recordings

LENGTHS = (0, 1, 7, 47, 48, 49, 96, 100, 333, 1000)


def waves():
    rng = np.random.default_rng(3)
    return {i: rng.normal(0, 0.3, n).astype(np.float32) for i, n in enumerate(LENGTHS)}


def chunks(spark, length):
    rows = [(i, y.tolist()) for i, y in waves().items()] + [(99, None)]
    return recordings.chunked(spark.createDataFrame(rows, "rec long, y array<float>"), "rec", "y", length)


@pytest.mark.parametrize("length", [1, 7, 48, 64, 5000])
@pytest.mark.parametrize(("frame", "hop", "keep"), [(48, 20, True), (48, 48, False), (5, 9, True)])
def test_frames_do_not_depend_on_chunks(spark, length, frame, hop, keep):
    got = {(r["id"], r["frame"]): r["samples"] for r in recordings.frames(chunks(spark, length), frame, hop, length, keep).collect()}
    want = {(i, k // hop): y[k : k + frame].tolist() for i, y in waves().items() for k in range(0, len(y) - frame + (1 if keep else 0), hop)}
    assert got == want


def test_estimates_equal_whole_waveforms(spark):
    whole = spark.createDataFrame([(i, y.tolist()) for i, y in waves().items() if len(y)], "rec long, y array<float>")
    want = {r["rec"]: r for r in whole.select("rec", waveforms.snr_estimate(F.col("y"), 8).alias("snr"), waveforms.rms(F.col("y")).alias("rms"), waveforms.peak(F.col("y")).alias("peak")).collect()}
    got = {r["id"]: r["snr_db"] for r in recordings.snr_estimates(chunks(spark, 30), 30, 8).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]["snr"]) for i in got)
    for r in recordings.moments(chunks(spark, 30)).collect():
        assert r["rms"] == pytest.approx(want[r["id"]]["rms"]) and r["peak"] == want[r["id"]]["peak"] and r["n"] == LENGTHS[r["id"]]


def test_quantiles_by_selection(spark):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0, 5.0], [2000, 1, 10]), "c": np.array([3.0]), "d": np.concatenate([rng.random(500) * 1e-9, [1e9, -1e9]]), "e": np.full(1000, 7.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("f", None), ("a", float("nan"))]
    q = [0.0, 0.013, 0.5, 0.9, 1.0]
    got = {(r["id"], r["q"]): r["value"] for r in recordings.quantiles(spark.createDataFrame(rows, "k string, v double"), q, "k", "v", most=20, buckets=8).collect()}
    assert got.keys() == {(k, x) for k in groups for x in q}
    for (k, x), v in got.items():
        assert v == pytest.approx(np.quantile(groups[k], x), rel=1e-9, abs=1e-15), (k, x)


def test_spectra_of_frames(spark):
    framed = recordings.frames(chunks(spark, 64), 48, 20, 64)
    n = framed.count()
    for r in recordings.spectra(framed).collect():
        y = waves()[r["id"]][20 * r["frame"] :][:48].astype(float)
        mag = np.abs(np.fft.rfft(y * np.hanning(49)[:48]))
        assert r["centroid_hz"] == pytest.approx((mag * np.fft.rfftfreq(48, 1 / 16000)).sum() / mag.sum())
        n -= 1
    assert n == 0


def loop(x, b, a):
    out, s1, s2 = np.empty_like(x), 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        out[i] = w = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * w + s2, b[2] * v - a[2] * w
    return out


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000, 20_001])
def test_sections_equal_the_recursion(n):
    x = np.random.default_rng(n).normal(size=n)
    for b, a in dsp.section_filter(200, 500, 16000) + dsp.section_filter(300, 3400, 16000):
        np.testing.assert_allclose(dsp.section_run(x, b, a), loop(x, b, a), atol=1e-9)


def test_sections_are_fast():
    x = np.random.default_rng(0).normal(size=160_000)
    b, a = dsp.section_filter(300, 3400, 16000)[0]
    took = []
    for run in (loop, dsp.section_run):
        run(x, b, a)
        start = time.perf_counter()
        run(x, b, a)
        took.append(time.perf_counter() - start)
    assert took[0] > 10 * took[1]  # some 20 to 40 times on a quiet machine


@pytest.mark.parametrize(("n", "m"), [(1, 1), (10, 3), (3, 10), (5000, 700), (100, 4000), (2048, 1024), (20_000, 513)])
def test_convolution_by_blocks(n, m):
    rng = np.random.default_rng(n + m)
    y, tail = rng.normal(size=n), rng.normal(size=m)
    np.testing.assert_allclose(dsp.convolved(y, tail), np.convolve(y, tail), atol=1e-9)
