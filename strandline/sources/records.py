"""Readers and writers of JSON records.

Order in a file can be observed by users (first rows, default ids, messages), so readers number the records: ``ordinal`` counts them from
nought over all files, ``line`` from one in each file.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.canonical import canonical_json
from strandline.functions.variants import kind
from strandline.sources.arrays import read_array
from strandline.sources.lines import numbered_lines

LEGACY = (
    "struct<id:string,clean_path:string,audio_path:string,split:string,"
    "degradation_config:struct<noise_type:string,snr_db:double,reverb_rt60:double,bandlimit:array<double>>>"
)


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(ordinal, file, line, record VARIANT, error) of the JSON objects of text files, one a line; blank lines are left out.

    ``strict`` ends the job at a bad line with its file and number; else ``error`` says what is wrong with it.
    """
    rows = numbered_lines(spark, path).withColumn("record", F.try_parse_json("value"))
    error = F.when(F.col("record").isNull(), "invalid JSON").when(kind(F.col("record")) != "object", "each row must be an object")
    said = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), error)
    return rows.select("ordinal", "file", "line", "record", F.when(error.isNotNull(), F.raise_error(said).cast("string") if strict else said).alias("error"))


def field(name: str, type_name: str = "string") -> Column:
    return F.try_variant_get("record", f"$.{name}", type_name).alias(name)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, sample_id, response); a row without an id or a text response raises in the job."""
    rows = read_jsonl(spark, path)
    bad = F.coalesce(field("sample_id"), F.lit("")).eqNullSafe("") | (kind(F.col("record"), "$.response") != "string")
    checked = F.when(bad, F.raise_error(F.lit("predictions require sample_id and string response")).cast("string")).otherwise(field("sample_id"))
    return rows.select("ordinal", checked.alias("sample_id"), field("response"))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON arrays with their position, read in parallel; each file is one array."""
    items = read_array(spark, path).select("position", F.from_json("text", LEGACY).alias("item"))
    return items.select("position", "item.*")


def read_native_manifest(spark: SparkSession, path: str, base: str, listing: DataFrame | None = None) -> DataFrame:
    """(sample_id, line, audio_path, target_text, violations); relative paths are taken from ``base``.

    Besides empty fields, violations name ids that stood on an earlier line and, given a ``listing`` (path) of the files there are, those that
    are not among them. A manifest without any record ends the job with an error.
    """
    names = ("sample_id", "audio_path", "target_text")
    rows = read_jsonl(spark, path).select("ordinal", "line", *[field(n) for n in names])
    if rows.isEmpty():
        raise ValueError("native audio manifest is empty")
    faults = [F.when(F.coalesce(F.col(n), F.lit("")) == "", f"{n}: missing") for n in names]
    own = F.when(F.col("audio_path").rlike("^([a-z]+:)?/"), F.col("audio_path")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "audio_path"))
    rows = rows.withColumn("faults", F.array(*faults)).withColumn("audio_path", own)
    rows = rows.join(rows.groupBy("sample_id").agg(F.min("ordinal").alias("first")), "sample_id", "left")
    more = [F.when(F.col("ordinal") > F.col("first"), "sample_id: duplicate")]
    if listing is not None:
        rows = rows.join(listing.select(F.col("path").alias("audio_path"), F.lit(True).alias("there")).distinct(), "audio_path", "left")
        more.append(F.when(F.col("there").isNull(), "audio_path: no file"))
    return rows.select("sample_id", "line", "audio_path", "target_text", F.filter(F.concat("faults", F.array(*more)), lambda x: x.isNotNull()).alias("violations"))


def json_line(rows: DataFrame) -> Column:
    """A row as canonical JSON text: keys sorted at every level, null fields kept."""
    return canonical_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}))


def write_jsonl(rows: DataFrame, path: str, order_col: str | None = None) -> None:
    """One JSON object a line; sorted by ``order_col`` over all files if it is given."""
    if order_col:
        rows = rows.orderBy(order_col)
    rows.select(json_line(rows).alias("value")).write.mode("overwrite").text(path)


def publish_json(spark: SparkSession, path: str, payload: dict) -> None:
    """A JSON file put in place in one step, in any file system of Hadoop: readers see the old one or the new one."""
    sc, text = spark.sparkContext, json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    fs = sc._jvm.org.apache.hadoop.fs
    target, part = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration()).rename(files.makeQualified(part), files.makeQualified(target), how)


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """(stage, split, file, bytes, rows, sha256) of the lines that ``write_bundle`` has put below ``path``, from the bytes in the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    parts = F.regexp_extract("path", r"/([^/]+)/split=([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"/split=([^/]+)/[^/]+$", 1)
    rows = F.length(F.regexp_replace(F.decode("content", "UTF-8"), "[^\n]", "")).cast("long")
    name = F.regexp_extract("path", r"[^/]+/split=[^/]+/[^/]+$", 0)
    return files.select(parts[0].alias("stage"), parts[1].alias("split"), name.alias("file"), F.col("length").alias("bytes"), rows.alias("rows"), F.sha2("content", 256).alias("sha256"))


def write_bundle(stages: dict[str, DataFrame], path: str, info: dict | None = None, records_per_file: int = 1_000_000) -> DataFrame:
    """Each stage as JSON lines in folders by split, and a manifest of what was written; returns rows by stage and split, with zeros.

    An old manifest goes first, and the new one is put in place after all tasks have committed: a manifest that is there tells of
    complete files, each with its rows and the sha256 of its bytes. Tasks that are run again count once, as only committed files are read. Rows without
    a split are in the counts and in no folder that readers of a split look into.
    """
    from strandline.operators.split import split_counts

    spark = next(iter(stages.values())).sparkSession
    manifest = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/dataset_manifest.json")
    manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(manifest, False)
    for name, rows in stages.items():
        lines = rows.select("split", json_line(rows).alias("value"))
        lines.write.mode("overwrite").option("maxRecordsPerFile", records_per_file).partitionBy("split").text(f"{path}/{name}")
    marks = [rows.select(F.lit(name).alias("stage"), "split") for name, rows in stages.items()]
    counts = split_counts(reduce(DataFrame.unionByName, marks))
    found = {r["stage"]: {k: v for k, v in r.asDict().items() if k != "stage"} for r in counts.collect()}
    files = {r["file"]: {"bytes": r["bytes"], "rows": r["rows"], "sha256": r["sha256"]} for r in written_files(spark, path).collect()}
    publish_json(spark, f"{path}/dataset_manifest.json", (info or {}) | {"counts": found, "files": files})
    return counts
