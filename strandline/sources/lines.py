"""Numbers for the lines of text files, however the files are split over tasks.

A first pass counts the lines of every split; sums over the splits before give each split its first number, and rows add
their place in the split. Only counts (one row a split) are shuffled, never the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from strandline.plans.runtime import cut, join_small

#: Bits of a running id below the number of its task.
TASK_BITS = 33
BLANK = "^\\s*$"


def read_pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, split, id, value) of the pieces of text files; within a split ids go up by one, in order."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    return reader.text(path).select(*meta, F.monotonically_increasing_id().alias("id"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, ordinal, value) of all lines that are not blank.

    ``line`` counts from one in each file, blank lines included; ``ordinal`` counts the lines that are not blank from nought over all files,
    in the order of their paths. If the files are split otherwise while they are read, which Spark does only when its settings or the files
    change, the job ends with an error instead of wrong numbers.
    """
    pieces = read_pieces(spark, path)
    filled = ~F.col("value").rlike(BLANK)
    counts = pieces.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.count_if(filled).alias("n_filled"))
    counts = cut(counts, "splits")
    task = Window.partitionBy(F.shiftright("first", TASK_BITS)).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # the number of files is that of a listing, so one task can add them up
    per_file = counts.groupBy("file").agg(F.sum("n_filled").alias("n_filled"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.select("file", F.coalesce(F.sum("n_filled").over(before), F.lit(0)).alias("files_before"))

    def earlier(name: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    starts = counts.select(
        "file", "split", "first", earlier("n", file).alias("lines_before"), earlier("n_filled", file).alias("filled_before"),
        (F.shiftleft(F.shiftright("first", TASK_BITS), TASK_BITS) + earlier("n_filled", task)).alias("first_filled"),
    ).join(per_file, "file")
    starts = cut(starts, "starts")
    rows = pieces.filter(filled).withColumn("id_filled", F.monotonically_increasing_id())
    placed = join_small(rows, starts, ["file", "split"])
    line = F.col("lines_before") + F.col("id") - F.col("first") + 1
    moved = F.raise_error(F.concat(F.lit("the files were split otherwise in the second pass: "), F.col("file"))).cast("long")
    return placed.select(
        "file", F.when(F.col("first").isNull(), moved).otherwise(line).alias("line"), (F.col("files_before") + F.col("filled_before") + F.col("id_filled") - F.col("first_filled")).alias("ordinal"), "value"
    )


def at_positions(rows: DataFrame, positions: DataFrame, ordinal_col: str = "ordinal") -> DataFrame:
    """The rows whose ordinal is among ``positions`` (one column), each once."""
    wanted = positions.select(F.col(f"`{positions.columns[0]}`").cast("long").alias(ordinal_col))
    return rows.join(wanted, ordinal_col, "left_semi")
