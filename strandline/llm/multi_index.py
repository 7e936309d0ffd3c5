"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of a vector's 64 components, cut into four segments of 16 bits. The index is one table of
(segment, value, code) for all codes, dealt over the cluster by segment and value. Queries are asked by code, radius by
radius: at radius r each looks up the values that differ from its own in exactly r bits of a segment, and the
full Hamming distances of the codes found are verified. A code is met once only, at the segment that is nearest to
the query's. A code not met at radius r differs by more than r in every segment, so by at least 4 (r + 1)
in all: as soon as the k-th verified distance is below that, the k nearest are certain, ties included, and the
query asks no more. Its best rows so far go on from radius to radius, whatever part of the index they came from, and so
does the distance of the last of them, beyond which no code is looked at any more.

The index is written once, bucketed by segment, value and part, so only what queries ask for is shuffled at each radius.
That is merged with it, never broadcast: Spark cannot know how many rows the probes of a few queries become.

Only values that stand in the index are looked up: there are 65,536 for each segment at most, whatever the number of
rows, so these four lists are sent to all tasks, with the number of parts of each value: the codes of a value that
many share are dealt over parts of about ``PART_CODES``, and each part is asked by itself. Equal vectors have one code, which carries the least ids of its rows
with their numbers, as many as any query can need, so a vector that a third of all rows share is one entry. Equal
queries are asked once.

Rows with a null vector or a null component are neither found nor asked; a short vector lacks the missing
signs (they count as not positive), and a longer one than 64 is an error. Ties go to the lesser id. A repeated row is
found as often as it stands; a query does not find the rows of its own id. Of an id with more than k codes a
query keeps the k nearest, as no answer can need more; so twice k rows are enough for every query, whatever ids
share its code. An id that asks with several vectors
gets an answer for each of them, without mark which. Other columns are not read. With fewer than k others, all
of them are returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.plans.runtime import cut, discard, join_small, shared_dir

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Codes of one segment value that are dealt together.
PART_CODES = 4096
#: Rows of the index in one bucket, up to as many buckets as the session shuffles into.
BUCKET_ROWS = 1 << 16
KEYS = ["segment", "value", "part"]


def sign_code(vector: Column) -> Column:
    """64 bits: bit i is set if component i is positive. Null for a null vector or component."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    long = F.raise_error(F.lit(f"vectors of more than {BITS} components have no code")).cast("long")
    return F.when(F.size(vector) > BITS, long).when(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull()), code)


def segment(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")).cast("int")


def _probes(values: list[tuple[np.ndarray, np.ndarray]], radius: int):
    """For each query code the values of the index at ``radius`` from its own and all their parts, segment by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds = batch.column("query").to_numpy().view(np.uint64), batch.column("bound").to_numpy()
            for start in range(0, len(codes), 256):
                part, bound = codes[start : start + 256], bounds[start : start + 256]
                for s, (have, parts) in enumerate(values):
                    own = ((part >> np.uint64(s * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16)
                    q, v = np.nonzero(np.bitwise_count(own[:, None] ^ have[None, :]) == radius)
                    times = parts[v]
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    q, v = np.repeat(q, times), np.repeat(v, times)
                    columns = [part[q].view(np.int64), bound[q], np.full(len(q), s, np.int32), have[v].astype(np.int32), nth.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "bound", *KEYS])

    return run


def _bucketed(index: DataFrame, rows: int) -> tuple[DataFrame, str]:
    """``index`` below the shared folder as a table that is bucketed by its keys, and the table's name."""
    spark, name = index.sparkSession, f"strandline_{uuid.uuid4().hex}"
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS)))
    path = f"{shared_dir(spark)}/strandline/{name}"
    index.repartition(n, *KEYS).write.bucketBy(n, *KEYS).sortBy(*KEYS).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_at = path
    return out, name


def _first_met(radius: int) -> Column:
    """Whether this probe is the one that meets the code: its segment is the nearest, the first of equals."""
    apart = [F.bit_count(segment(F.col("query"), s).bitwiseXOR(segment(F.col("code"), s))) for s in range(SEGMENTS)]
    earlier = F.lit(False)
    for s, d in enumerate(apart):
        earlier = earlier | (d < radius) | ((d == radius) & (F.col("segment") > s))
    return ~earlier


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance, radius) of the ``k`` rows nearest to each row that ``is_query``.

    ``radius`` is the last segment radius that the query was searched to.
    """
    coded = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), sign_code(F.col(f"`{vector_col}`")).alias("code"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    coded = cut(coded.filter("id is not null and code is not null"), "codes")
    stood = cut(coded.groupBy("code", "id").agg(F.count("*").alias("n"), F.max("asks").alias("asks")), "stood")
    # a query leaves out its own id, which may have several codes: so many more rows are kept, k at most
    codes_of = stood.groupBy("id").agg(F.count("*").alias("codes"))
    most = codes_of.agg(F.max("codes")).first()[0] or 1
    wanted = k + min(most, k)
    if most > k:
        crowds = cut(codes_of.filter(F.col("codes") > k).select("id", F.lit(True).alias("crowded")), "crowds")
        stood = join_small(stood, crowds, ["id"]).withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    else:
        stood = stood.withColumn("crowded", F.lit(False))
    least = stood.withColumn("at", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("at") <= wanted)
    entries = cut(least.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("id", F.least("n", F.lit(k)).alias("n"), "crowded"))).alias("ids")), "entries")
    index = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)]))
    index = cut(entries.select("code", index.alias("i")).select("i.segment", "i.value", "code"), "segments")
    listed = entries.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    # one row for each value of a segment: 4 * 65,536 at most
    parts = F.ceil(F.count("*") / PART_CODES).cast("int").alias("parts")
    sizes = cut(index.groupBy("segment", "value").agg(parts, F.count("*").alias("rows")), "values")
    values = [(np.zeros(0, np.uint16), np.zeros(0, np.int64))] * SEGMENTS
    listing = F.sort_array(F.collect_list(F.struct("value", "parts")))
    for r in sizes.groupBy("segment").agg(listing.alias("v")).select("segment", "v.value", "v.parts").collect():
        values[r["segment"]] = (np.array(r["value"], np.uint16), np.array(r["parts"], np.int64))
    # the values of several parts are sent to all tasks once, when the index is written with its parts
    dealt = index.join(F.broadcast(sizes.filter("parts > 1")), ["segment", "value"], "left")
    whole, part = index, F.coalesce(F.pmod(F.xxhash64("code"), F.col("parts")), F.lit(0)).cast("int")
    index, name = _bucketed(dealt.select("segment", "value", part.alias("part"), "code"), sizes.agg(F.sum("rows")).first()[0] or 0)
    discard(whole, sizes)

    open_queries = cut(stood.filter("asks").select(F.col("code").alias("query"), F.lit(BITS).cast("long").alias("bound")).distinct(), "queries")
    best = found = None
    order = Window.partitionBy("query").orderBy("distance", "id")
    for radius in range(WIDTH + 1):
        probes = open_queries.mapInArrow(_probes(values, radius), "query long, bound long, segment int, value int, part int")
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("long").alias("distance")
        near = probes.hint("merge").join(index, KEYS).filter(_first_met(radius)).select("query", "code", "bound", distance)
        near = near.filter("distance <= bound").drop("bound")
        new = near.join(entries, "code").select("query", "distance", F.explode("ids").alias("e")).select("query", "distance", "e.*")
        kept = new if best is None else new.unionByName(best)
        if most > k:
            of_id = F.row_number().over(Window.partitionBy("query", "id").orderBy("distance"))
            crowd = kept.filter("crowded").withColumn("of_id", of_id).filter(F.col("of_id") <= k).drop("of_id")
            kept = kept.filter("not crowded").unionByName(crowd)
        kept = kept.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= wanted)
        kept = cut(kept.select("query", "distance", "id", "n", "crowded", (F.max("at").over(Window.partitionBy("query")) == min(wanted, listed)).alias("full"), F.max("distance").over(Window.partitionBy("query")).alias("last")), "best")
        # certain if what is left is farther, or if nothing is left
        sure = F.col("full") & ((F.col("last") < SEGMENTS * (radius + 1)) | F.lit(listed <= wanted)) if radius < WIDTH else F.lit(True)
        columns = ["query", "distance", "id", "n", "crowded"]
        done = kept.filter(sure).select(*columns, F.lit(radius).cast("long").alias("radius"))
        found = done if found is None else found.unionByName(done)
        reached = kept.groupBy("query").agg(F.bool_and(sure).alias("sure"), F.first(F.when(F.col("full"), F.col("last"))).alias("last"))
        still = open_queries.join(reached, "query", "left").filter(~F.coalesce("sure", F.lit(False)))
        still = cut(still.select("query", F.coalesce("last", "bound").alias("bound")), "queries")
        discard(open_queries)
        open_queries, best = still, kept.filter(~sure).select(*columns)
        if still.isEmpty():
            break
    discard(index)
    rows.sparkSession.sql(f"DROP TABLE {name}")

    asked = stood.filter("asks").select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    answers = asked.join(found, "query").filter("id <> query_id")
    each = answers.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance", "radius")
