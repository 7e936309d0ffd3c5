"""Long recordings as tables of chunks, so that no task holds a recording.

A chunk is a row (id, chunk, samples). Chunks of a recording have one length, but for the last. What looks across borders, frames or transforms, gets a
halo: the first samples of the next chunks, sent to the chunk that needs them, so only halos are shuffled besides the chunks' ids. Every result
is that of the whole recording, whatever the length of the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.plans.runtime import cut, join_small


def chunked(rows: DataFrame, id_col: str, audio_col: str, length: int) -> DataFrame:
    """(id, chunk, start, samples) of recordings that still stand in one row each; null and empty ones have no chunk."""
    y = F.col(f"`{audio_col}`")
    n = F.ceil(F.size(y) / length).cast("int")
    each = rows.filter(F.size(y) > 0).select(F.col(f"`{id_col}`").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk"), F.slice(y, i * length + 1, length).alias("samples")))).alias("c"))
    return each.select("id", F.col("c.chunk").cast("long").alias("chunk"), (F.col("c.chunk").cast("long") * length).alias("start"), "c.samples")


def with_halo(chunks: DataFrame, halo: int, length: int) -> DataFrame:
    """``chunks`` with ``after``, the ``halo`` samples that follow each chunk, fewer at the end. ``length`` is that of the chunks."""
    if halo <= 0:
        return chunks.withColumn("after", F.array().cast("array<float>"))
    reach = -(-halo // length)
    pieces = []
    for d in range(1, reach + 1):
        take = min(length, halo - (d - 1) * length)
        pieces.append(chunks.select("id", (F.col("chunk") - d).alias("chunk"), F.lit(d).alias("d"), F.slice("samples", 1, take).alias("part")).filter("chunk >= 0"))
    sent = pieces[0]
    for p in pieces[1:]:
        sent = sent.unionByName(p)
    after = sent.groupBy("id", "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("d", "part"))), lambda x: x["part"])).alias("after"))
    return chunks.join(after, ["id", "chunk"], "left").withColumn("after", F.coalesce("after", F.array().cast("array<float>")))


def frames(chunks: DataFrame, frame: int, hop: int, length: int, keep_last: bool = True) -> DataFrame:
    """(id, frame, samples) of all whole frames of ``frame`` samples, ``hop`` apart; a frame belongs to the chunk it begins in.

    Without ``keep_last`` a frame that would end exactly with the recording is left out.
    """
    whole = with_halo(chunks, frame - 1 if keep_last else frame, length)
    y = F.concat("samples", "after")
    first = F.ceil(F.col("start") / hop).cast("long")
    room = F.size(y) - frame - (0 if keep_last else 1)
    # beginnings inside this chunk whose frame ends inside what there is
    last = F.floor((F.col("start") + F.least(F.size("samples") - 1, room)) / hop).cast("long")
    numbers = F.when((last >= first) & (room >= 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    each = whole.select("id", "start", y.alias("y"), F.explode(numbers).alias("frame"))
    return each.select("id", "frame", F.slice("y", (F.col("frame") * hop - F.col("start") + 1).cast("int"), frame).alias("samples"))


def frame_energies(chunks: DataFrame, length: int, frame: int = 400) -> DataFrame:
    """(id, frame, energy) of frames that do not overlap; one that would end exactly with the recording is left out."""
    square = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return frames(chunks, frame, frame, length, keep_last=False).select("id", "frame", square.alias("energy"))


def moments(chunks: DataFrame) -> DataFrame:
    """(id, n, mean, rms, peak) of each recording, added up from its chunks."""
    x = F.transform("samples", lambda v: v.cast("double"))
    parts = chunks.select("id", F.size("samples").alias("n"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v).alias("q"), F.array_max(F.transform(x, lambda v: F.abs(v))).alias("p"))
    n = F.sum("n")
    return parts.groupBy("id").agg(n.alias("n"), (F.sum("s") / n).alias("mean"), F.sqrt(F.sum("q") / n).alias("rms"), F.max("p").alias("peak"))


def quantiles(values: DataFrame, q: list[float], id_col: str = "id", value_col: str = "value", most: int = 4096, buckets: int = 256) -> DataFrame:
    """(id, q, value): quantiles with linear interpolation of the values of each id, by selection.

    For each rank that is wanted the range in which its value lies is cut into ``buckets`` parts, whose values are counted; the part that holds the rank is the
    next range, until it holds ``most`` values at most, or equal ones. So no task sorts or gathers the values of an id. Nulls and values
    that are no number are left out; an id without any has no row.
    """
    rows = cut(values.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{value_col}`").cast("double").alias("v")).filter("v is not null and not isnan(v)"), "values")
    span = cut(rows.groupBy("id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "spans")
    asked = span.withColumn("q", F.explode(F.array(*map(F.lit, q)))).withColumn("at", (F.col("n") - 1) * F.col("q"))
    ends = F.array_distinct(F.array(F.floor("at"), F.ceil("at")))
    going = asked.select("id", F.explode(ends).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")).distinct()
    going, found = cut(going, "ranges"), None
    while True:
        settled = going.filter("lo = hi").select("id", "rank", F.col("lo").alias("value"))
        few = going.filter((F.col("lo") < F.col("hi")) & (F.col("inside") <= most))
        near = _within(rows, few).groupBy("id", "rank").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("before").alias("before"))
        picked = near.select("id", "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("value"))
        now = cut(settled.unionByName(picked), "found")
        found = now if found is None else found.unionByName(now)
        many = going.filter((F.col("lo") < F.col("hi")) & (F.col("inside") > most))
        part = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).cast("int")
        counted = _within(rows, many).groupBy("id", "rank", part.alias("part")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("before").alias("before"))
        order = Window.partitionBy("id", "rank").orderBy("part")
        upto = F.col("before") + F.sum("inside").over(order)
        narrowed = counted.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("inside")))
        going = cut(narrowed.select("id", "rank", "lo", "hi", (F.col("upto") - F.col("inside")).alias("before"), "inside"), "ranges")
        if going.isEmpty():
            break
    low, high = (found.select("id", F.col("rank").alias(name), F.col("value").alias(f"v_{name}")) for name in ("below", "above"))
    out = asked.withColumn("below", F.floor("at")).withColumn("above", F.ceil("at")).join(low, ["id", "below"]).join(high, ["id", "above"])
    return out.select("id", "q", (F.col("v_below") + (F.col("v_above") - F.col("v_below")) * (F.col("at") - F.col("below"))).alias("value"))


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values of each range; ranges are few for each id."""
    of_id = ranges.groupBy("id").agg(F.collect_list(F.struct("rank", "lo", "hi", "before")).alias("ranges"))
    each = join_small(rows, cut(of_id, "of-id"), ["id"], "inner").select("id", "v", F.explode(F.filter("ranges", lambda r: F.col("v").between(r["lo"], r["hi"]))).alias("r"))
    return each.select("id", "v", "r.*")


def snr_estimates(chunks: DataFrame, length: int, frame: int = 400) -> DataFrame:
    """(id, snr_db): the ratio of loud to quiet frames of each recording in dB, clipped to [3, 30]; 15 for four frames or fewer."""
    energies = frame_energies(chunks, length, frame).filter("energy > 0")
    energies = cut(energies, "energies")
    levels = quantiles(energies, [0.1, 0.9], value_col="energy").groupBy("id").agg(F.max_by("value", "q").alias("hi"), F.min_by("value", "q").alias("lo"))
    counted = levels.join(energies.groupBy("id").agg(F.count("*").alias("n")), "id")
    ratio = F.when(F.col("n") > 4, F.greatest(F.lit(3.0), F.least(F.lit(30.0), 10 * F.log10(F.col("hi") / (F.col("lo") + 1e-9))))).otherwise(15.0)
    return chunks.select("id").distinct().join(counted.select("id", ratio.alias("snr_db")), "id", "left").select("id", F.coalesce("snr_db", F.lit(15.0)).alias("snr_db"))


def spectra(framed: DataFrame, rate: int = 16000) -> DataFrame:
    """(id, frame, flatness, centroid_hz) of frames, each under a Hann window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("samples").value_lengths().to_numpy()
            for n in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                y = part.column("samples").flatten().to_numpy().astype(float).reshape(-1, n)
                mag = np.abs(np.fft.rfft(y * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)), axis=1))
                power = np.maximum(mag**2, 1e-10)
                flat = np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)
                centre = (mag * np.fft.rfftfreq(n, 1 / rate)).sum(axis=1) / np.maximum(mag.sum(axis=1), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("frame"), pa.array(flat), pa.array(centre)], names=["id", "frame", "flatness", "centroid_hz"])

    return framed.select("id", "frame", "samples").mapInArrow(run, "id long, frame long, flatness double, centroid_hz double")
