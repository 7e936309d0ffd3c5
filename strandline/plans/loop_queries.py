"""Queries of the closed loop with a reviser, over rows and over a stream, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import waveforms
from strandline.operators import closed_loop
from strandline.plans.runtime import shared_dir, table
from strandline.streaming import enhancement, status

REVISIONS, LEAST = 2, 0.01


def _first_plan() -> Column:
    """A gain, and for odd ids the removal of the mean after it."""
    gain = F.struct(F.lit("gain").alias("kind"), (F.col("vec_id") % 5).cast("double").alias("value"))
    centre = F.struct(F.lit("dc_remove").alias("kind"), F.lit(0.0).alias("value"))
    return F.when(F.col("vec_id") % 2 == 1, F.array(gain, centre)).otherwise(F.array(gain))


def _loudness(y: Column) -> Column:
    """Metrics by how near the loudness is to a quarter, and how many samples are at the limit."""
    none, clipped = F.lit(None).cast("double"), F.size(F.filter(y, lambda x: F.abs(x) >= 1)) / F.size(y)
    fields = {"stoi": 1 - 2 * F.abs(waveforms.rms(y) - 0.25), "wer": clipped}
    return F.struct(*[fields.get(k, none).alias(k) for k in closed_loop.WEIGHTS])


def _softer_or_louder(plan: Column, before: Column, after: Column) -> Column:
    value = plan[0]["value"]
    first = F.struct(F.lit("gain").alias("kind"), F.when(value > 2, value * 0.5).otherwise(value * 1.5).alias("value"))
    return F.when(value != 2, F.concat(F.array(first), F.slice(plan, 2, closed_loop.MAX_ACTIONS)))


def closed_loop_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a waveform with a plan of its own, revised twice at most."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("y"), _first_plan().alias("plan"))
    out = closed_loop.enhance(rows, "y", "plan", _loudness, _softer_or_louder, REVISIONS, LEAST)
    gains = F.array_join(F.transform("attempts", lambda a: F.element_at(a["plan"], 1)["value"].cast("string")), ",")
    return out.select(
        "vec_id", "decision", F.size("attempts").alias("n_attempts"), F.array_join("attempts.decision", ",").alias("steps"), gains.alias("gains"), F.round("utility_gain", 6).alias("utility_gain"),
        F.round(waveforms.power(F.col("kept_audio")), 6).alias("kept_power"),
    )


def loudness(y: np.ndarray) -> dict[str, float | None]:
    y = np.asarray(y, float)
    return {"stoi": 1 - 2 * abs(float(np.sqrt(np.mean(y * y))) - 0.25), "wer": float(np.mean(np.abs(y) >= 1))}


def softer_or_louder(plan: enhancement.Plan, before: enhancement.Metrics, after: enhancement.Metrics) -> enhancement.Plan | None:
    (kind, value), *rest = plan
    return None if value == 2 else [(kind, value * 0.5 if value > 2 else value * 1.5), *rest]


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, be it a folder or a single file of one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def closed_loop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same loop over a stream of the table's files; one row for each attempt that was made."""
    items = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").alias("audio"), _first_plan().alias("plan"))
    loop = enhancement.EnhancementLoop(loudness, softer_or_louder, REVISIONS, LEAST, paced=False)
    path = f"{shared_dir(spark)}/strandline/loop-{uuid.uuid4().hex}"
    sink = enhancement.enhanced(items, loop).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{path}/rows")
    return found.select(
        F.col("sample_id").cast("long").alias("vec_id"), "attempt", F.element_at("plan", 1)["value"].alias("gain"), F.size("plan").alias("n_actions"), F.round("utility_gain", 6).alias("utility_gain"), "decision"
    )


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a run over a stream of events, once it is over, with the sum of what it wrote."""
    path = f"{shared_dir(spark)}/strandline/run-{uuid.uuid4().hex}"
    rows = _stream(spark, sf_dir, "events").select("event_id", "value")
    query = status.start_tracked(rows, "events", f"{path}/rows", f"{path}/checkpoint", f"{path}/status.json")
    state = status.finish(query, f"{path}/status.json")
    told = [F.lit(state["name"]).alias("name"), F.lit(state["status"]).alias("status"), F.lit(state["rows"]).cast("long").alias("rows")]
    return spark.read.parquet(f"{path}/rows").agg(F.sum("event_id").alias("id_sum")).select(*told, "id_sum")


QUERIES = {"stream_status": stream_status, "closed_loop_revised": closed_loop_revised, "closed_loop_stream": closed_loop_stream}


def _utility(y: str) -> str:
    loud = f"sqrt(list_sum(list_transform({y}, lambda x: x::DOUBLE * x::DOUBLE)) / len({y}))"
    return f"(0.2 * least(1.0, greatest(0.0, 1 - 2 * abs({loud} - 0.25))) + 0.15 * (1 - len(list_filter({y}, lambda x: abs(x) >= 1)) / len({y}))) / (0.2 + 0.15)"


def _attempts_sql() -> str:
    parts = [f"WITH v0 AS (SELECT vec_id, embedding AS y, (vec_id % 5)::DOUBLE AS g, {_utility('embedding')} AS u0 FROM embeddings)"]
    for n in range(1, REVISIONS + 2):
        parts.append(
            f"""s{n} AS (SELECT *, list_transform(y, lambda x: greatest(-1.0, least(1.0, x::DOUBLE * g))::FLOAT) AS z FROM v{n - 1} WHERE g IS NOT NULL),
m{n} AS (SELECT * REPLACE (CASE WHEN vec_id % 2 = 1 THEN list_transform(z, lambda x: (x::DOUBLE - list_sum(list_transform(z, lambda i: i::DOUBLE)) / len(z))::FLOAT) ELSE z END AS z) FROM s{n}),
t{n} AS (SELECT *, {_utility("z")} - u0 AS d FROM m{n}),
a{n} AS (SELECT *, {n} AS attempt, CASE WHEN d >= {LEAST} THEN 'accept' WHEN {n} > {REVISIONS} OR g = 2 THEN 'rollback' ELSE 'revise' END AS decision FROM t{n}),
v{n} AS (SELECT vec_id, y, CASE WHEN g > 2 THEN g * 0.5 ELSE g * 1.5 END AS g, u0 FROM a{n} WHERE decision = 'revise')"""
        )
    return ",\n".join(parts) + ",\na AS (" + " UNION ALL ".join(f"SELECT vec_id, y, z, g, d, attempt, decision FROM a{n}" for n in range(1, REVISIONS + 2)) + ")\n"


ORACLE_SQL = {
    "stream_status": "SELECT 'events' AS name, 'complete' AS status, count(*) AS rows, sum(event_id)::BIGINT AS id_sum FROM events",
    "closed_loop_revised": _attempts_sql()
    + """SELECT vec_id, arg_max(decision, attempt) AS decision, count(*)::INTEGER AS n_attempts, string_agg(decision, ',' ORDER BY attempt) AS steps,
       string_agg(g::VARCHAR, ',' ORDER BY attempt) AS gains, round(arg_max(d, attempt), 6) + 0.0 AS utility_gain,
       round(list_sum(list_transform(arg_max(CASE WHEN decision = 'accept' THEN z ELSE y END, attempt), lambda x: x::DOUBLE * x::DOUBLE)) / 64, 6) AS kept_power
FROM a GROUP BY vec_id""",
    "closed_loop_stream": _attempts_sql() + "SELECT vec_id, attempt, g AS gain, (1 + vec_id % 2)::INTEGER AS n_actions, round(d, 6) + 0.0 AS utility_gain, decision FROM a",
}
