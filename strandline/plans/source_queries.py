"""Queries that write a table in a text form, read it with the sources of the library, and their SQL over the table itself."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.runtime import shared_dir, table
from strandline.sources import arrays, lines, records

#: What a text may hold that a reader of brackets and quotes must not take for structure.
ODD = '}"\\{[é'


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")


def _write_lines(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines in order, some of them broken or no objects, with blank lines between."""
    k = F.col("event_id")
    record = F.to_json(F.struct("event_id", "props"))
    text = F.when(k % 50 == 7, F.concat(F.lit('{"event_id": '), k.cast("string"))).when(k % 70 == 9, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(record)
    path = _place(spark, "lines")
    _events(spark, sf_dir).orderBy("event_id").select(F.concat(text, F.when(k % 3 == 0, "\n  \n").otherwise("")).alias("value")).write.text(path)
    return path


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON lines with their position, and what is wrong with the others."""
    rows = records.read_jsonl(spark, _write_lines(spark, sf_dir), strict=False)
    said = F.regexp_replace("error", r"^.*:\d+: ", "")
    return rows.select("ordinal", F.try_variant_get("record", "$.event_id", "long").alias("event_id"), said.alias("error"))


def rows_at_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines at the positions that customers' keys name."""
    rows = lines.numbered_lines(spark, _write_lines(spark, sf_dir))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey") * 3)
    return lines.at_positions(rows, wanted).select("ordinal", F.sha2("value", 256).alias("sha256"))


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        texts = batch.column(0)
        marks = pa.array(["[" if first else ",", ","]).take(pa.array(np.minimum(np.arange(len(texts)), 1)))
        first = first and not len(texts)
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, texts, "")], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])


def json_array_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from files that are JSON arrays, read in parallel, with texts full of brackets and quotes."""
    item = F.to_json(F.struct("event_id", "props", F.concat(F.lit(ODD), F.col("event_type")).alias("odd"), F.struct(F.array("value").alias("values")).alias("inner")))
    path = _place(spark, "arrays")
    _events(spark, sf_dir).select(item.alias("value")).mapInArrow(_as_array, "value string").write.text(path)
    shape = "struct<event_id:long,props:string,odd:string,inner:struct<values:array<double>>>"
    found = arrays.read_array(spark, path).select(F.from_json("text", shape).alias("e"))
    return found.select("e.event_id", "e.props", "e.odd", F.col("e.inner.values")[0].alias("value"))


def _bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nested fields, in splits, some without one."""
    k = F.col("event_id") % 10
    split = F.when(k == 0, "eval").when(k == 1, "test").when(k < 9, "train")
    nested = F.struct(F.col("value").alias("z"), F.struct(F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("a")).alias("b"))
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), split.alias("split"), nested.alias("acoustics"), F.array(F.lit("é"), "event_type").alias("tags"))


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON line of each row, byte for byte."""
    rows = _bundle_rows(spark, sf_dir)
    return rows.select("id", F.sha2(records.json_line(rows), 256).alias("sha256"))


def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bundle's files hold by their own bytes: rows and bytes of each stage and split, as its manifest says."""
    path, rows = _place(spark, "bundle"), _bundle_rows(spark, sf_dir)
    records.write_bundle({"sft": rows, "dpo": rows.drop("tags")}, path, {"seed": 42}, 1000)
    manifest = spark.read.text(f"{path}/dataset_manifest.json", wholetext=True)
    files = F.from_json(F.get_json_object("value", "$.files"), "map<string,struct<bytes:long,rows:long,sha256:string>>")
    each = manifest.select(F.explode(files).alias("file", "of"))
    stage, split = F.split("file", "/")[0], F.regexp_extract("file", "split=([^/]+)", 1)
    return each.groupBy(stage.alias("stage"), split.alias("split")).agg(F.sum("of.rows").alias("rows"), F.sum("of.bytes").alias("bytes"))


QUERIES = {q.__name__: q for q in (json_lines, rows_at_positions, json_array_items, canonical_lines, bundle_files)}

_ORDERED = """WITH o AS (SELECT event_id, props, row_number() OVER (ORDER BY event_id) - 1 AS ordinal,
  event_id % 50 = 7 AS cut, event_id % 50 <> 7 AND event_id % 70 = 9 AS listed FROM events)
"""
_LINE = """WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'eval' WHEN event_id % 10 = 1 THEN 'test' WHEN event_id % 10 < 9 THEN 'train' END AS split,
  '{"acoustics": {"b": {"a": null, "kind": "' || event_type || '"}, "z": ' || coalesce(value::VARCHAR, 'null') || '}, "id": ' || event_id || ', "split": ' AS head, ', "tags": ["é", "' || event_type || '"]}' AS tags FROM events),
s AS (SELECT id, split, head || coalesce('"' || split || '"', 'null') AS body, tags FROM r)
"""
ORACLE_SQL = {
    "json_lines": _ORDERED + "SELECT ordinal, CASE WHEN NOT cut AND NOT listed THEN event_id END AS event_id, CASE WHEN cut THEN 'invalid JSON' WHEN listed THEN 'each row must be an object' END AS error FROM o",
    "rows_at_positions": _ORDERED
    + """SELECT ordinal, sha256(CASE WHEN cut THEN '{"event_id": ' || event_id WHEN listed THEN '[' || event_id || ']'
  ELSE '{"event_id":' || event_id || ',"props":"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '"}' END) AS sha256
FROM o WHERE ordinal IN (SELECT c_custkey * 3 FROM customer)""".replace("\\\\", "\\"),
    "json_array_items": "SELECT event_id, props, '}\"\\{[é' || event_type AS odd, value FROM events",
    "canonical_lines": _LINE + "SELECT id, sha256(body || tags) AS sha256 FROM s",
    "bundle_files": _LINE
    + """SELECT stage, coalesce(split, '__HIVE_DEFAULT_PARTITION__') AS split, count(*)::BIGINT AS rows, sum(strlen(CASE stage WHEN 'sft' THEN body || tags ELSE body || '}' END) + 1)::BIGINT AS bytes
FROM s, (VALUES ('sft'), ('dpo')) t(stage) GROUP BY stage, split""",
}
