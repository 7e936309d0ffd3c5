import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import dsp
from strandline.operators import closed_loop
from strandline.plans import loop_queries
from strandline.streaming import enhancement

ITEMS = [(f"s{i}", np.random.default_rng(i).normal(0, 0.1 + 0.02 * (i % 3), 40 + i).astype(np.float32).tolist(), [("gain", float(i % 5)), *([("spectral_gate", 0.2)] if i % 3 == 0 else []), *([("dc_remove", 0.0)] if i % 2 else [])]) for i in range(40)]


def plain(audio, plan, revisions=2, least=0.01):
    """Every attempt of one item: (plan, gain, decision), and what is kept."""
    out, source = [], np.array(audio, np.float32)
    before = enhancement.utility(loop_queries.loudness(source))
    for at in range(revisions + 1):
        candidate = dsp.acted(source, plan)
        gain = enhancement.utility(loop_queries.loudness(candidate)) - before
        after = loop_queries.softer_or_louder(plan, None, None) if at < revisions else None
        decision = "accept" if gain >= least else "rollback" if after is None else "revise"
        out.append(([tuple(a) for a in plan], round(gain, 6), decision))
        if decision != "revise":
            return out, candidate if decision == "accept" else source
        plan = after


def frame(spark, items=ITEMS):
    return spark.createDataFrame([(i, a, [(k, v) for k, v in p], "x") for i, a, p in items], f"{enhancement.ITEMS}, attempts string")


def test_rounds_equal_a_plain_loop(spark):
    got = closed_loop.enhance(frame(spark), "audio", "plan", loop_queries._loudness, loop_queries._softer_or_louder, 2, 0.01).collect()
    assert len(got) == len(ITEMS)
    for r in got:
        i, audio, plan = next(x for x in ITEMS if x[0] == r["sample_id"])
        steps, kept = plain(audio, plan)
        assert [([tuple(a) for a in s["plan"]], round(s["utility_gain"], 6), s["decision"]) for s in r[-1]] == steps, i
        np.testing.assert_allclose(r["kept_audio"], kept, atol=1e-6)
        assert r["decision"] == steps[-1][2]


def test_attempts_that_are_not_made_are_not_computed(spark):
    made = spark.sparkContext.accumulator(0)

    def counting(y, plan):
        @F.pandas_udf("array<float>")
        def run(y, kinds, values):
            made.add(len(y))
            return y

        return run(y, F.transform(plan, lambda a: a["kind"]), F.transform(plan, lambda a: a["value"]))

    rows = frame(spark).repartition(3)
    measure = lambda y: F.struct(*[F.lit(0.5).alias(k) for k in closed_loop.WEIGHTS])
    closed_loop.enhance(rows, "audio", "plan", measure, lambda p, b, a: p, 5, 0.0, counting).count()
    assert made.value == len(ITEMS)  # all accepted at once
    closed_loop.enhance(rows, "audio", "plan", measure, lambda p, b, a: F.when(p[0]["value"] > 2, p), 2, 0.1, counting).count()
    again = sum(p[0][1] > 2 for _, _, p in ITEMS)
    assert made.value == 2 * len(ITEMS) + 2 * again
    closed_loop.enhance(rows, "audio", "plan", measure, None, 2, 0.1, counting).count()
    assert made.value == 3 * len(ITEMS) + 2 * again


def test_faults_end_the_loop(spark):
    def run(audio, plan, **more):
        return closed_loop.enhance(frame(spark, [("a", audio, plan)]), "audio", "plan", more.pop("measure", loop_queries._loudness), **more).collect()

    for plan, said in (([], "empty"), ([("gain", 5.0)], "gain"), ([("echo", 1.0)], "unknown"), ([("gain", 1.0)] * 9, "too long"), ([("spectral_gate", 2.0)], "gate")):
        with pytest.raises(Exception, match=said):
            run([0.1, 0.2], plan)
        with pytest.raises(ValueError):
            enhancement.sound(plan)
    for audio in ([], None):
        with pytest.raises(Exception, match="non-empty"):
            run(audio, [("gain", 1.0)])
    with pytest.raises(Exception, match="no objective metric"):
        run([0.1], [("gain", 1.0)], measure=lambda y: F.struct(*[F.lit(None).cast("double").alias(k) for k in closed_loop.WEIGHTS]))
    with pytest.raises(ValueError, match="negative"):
        run([0.1], [("gain", 1.0)], max_revisions=-1)
    assert closed_loop.enhance(frame(spark).limit(0), "audio", "plan", loop_queries._loudness).count() == 0


def start(spark, source, out, checkpoint, loop, **trigger):
    stream = spark.readStream.schema(enhancement.ITEMS).option("maxFilesPerTrigger", 1).parquet(str(source))
    sink = enhancement.enhanced(stream, loop).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint))
    return sink.trigger(**trigger).start()


def until(spark, query, out, ready, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        time.sleep(0.5)
        if query.exception():
            raise query.exception()
        try:
            if ready(spark.read.schema(enhancement.OUT).parquet(str(out))):
                break
        except Exception as e:  # nothing is written yet
            assert "PATH_NOT_FOUND" in str(e) or "not exist" in str(e)
    query.stop()


def rows_of(spark, out):
    return sorted((r["sample_id"], r["attempt"], tuple((a["kind"], a["value"]) for a in r["plan"]), round(r["utility_gain"], 6), r["decision"]) for r in spark.read.parquet(str(out)).collect())


WANT = sorted((i, n + 1, tuple(p), g, d) for i, a, plan in ITEMS for n, (p, g, d) in enumerate(plain(a, plan)[0]))


def test_stream_equals_a_plain_loop_across_a_restart(spark, tmp_path):
    """The first run is stopped between the attempts of items; the second one goes on, with repeated items besides new ones."""
    loop = enhancement.EnhancementLoop(loop_queries.loudness, loop_queries.softer_or_louder, 2, 0.01)
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    frame(spark, ITEMS[:25]).drop("attempts").coalesce(1).write.parquet(str(source))
    until(spark, start(spark, source, out, checkpoint, loop, processingTime="0 seconds"), out, lambda rows: rows.filter("attempt = 1").count() >= 25)
    early = rows_of(spark, out)
    frame(spark, ITEMS[20:]).drop("attempts").coalesce(1).write.mode("append").parquet(str(source))
    until(spark, start(spark, source, out, checkpoint, loop, processingTime="0 seconds"), out, lambda rows: rows.filter("decision <> 'revise'").count() >= len(ITEMS))
    assert rows_of(spark, out) == WANT
    assert set(early) <= set(WANT)
    kept = {r["sample_id"]: r["kept_audio"] for r in spark.read.parquet(str(out)).filter("kept_audio is not null").collect()}
    for i, audio, plan in ITEMS:
        np.testing.assert_allclose(kept[i], plain(audio, plan)[1], atol=1e-6)


def test_stream_over_what_is_there(spark, tmp_path):
    loop = enhancement.EnhancementLoop(loop_queries.loudness, loop_queries.softer_or_louder, 2, 0.01, paced=False)
    frame(spark, ITEMS + ITEMS[:7]).drop("attempts").repartition(4).write.parquet(str(tmp_path / "in"))
    start(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", loop, availableNow=True).awaitTermination()
    assert rows_of(spark, tmp_path / "out") == WANT


def test_utilities_agree(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(None if rng.random() < 0.4 else float(x) for x in rng.normal(1, 3, 6)) for _ in range(60)]
    rows = [r for r in rows if any(v is not None for v in r)]
    names = list(closed_loop.WEIGHTS)
    got = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select("*", closed_loop.utility(F.struct(*names)).alias("u")).collect()
    assert all(r["u"] == pytest.approx(enhancement.utility({n: r[n] for n in names})) for r in got)
