"""JSON arrays of objects, read in parallel from any place of a file.

The text is cut at every closing brace, which Spark does in all splits at once. What a split does to the reader's state does not need the splits
before it: the number of its quotes says whether it ends inside a string if it begins outside, and the other way round, and the
brackets outside of strings give a change of depth for either case. A first pass gives one row a split; sums over the splits of a file tell each
where it begins. An item ends with the brace that leaves depth one, the least depth there is within an array, so for either case a split tells
how often it comes to its least depth, and at which piece first and last. A second pass puts the items within a split together where they stand;
the pieces at the edges of splits, of items that may cross them, are gathered by their position. So no text but that of the edges is
shuffled or written, and no task holds more than some of a split's pieces, and one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.plans.runtime import cut, join_small
from strandline.sources.lines import read_pieces

#: Up to so many splits, their states are sent to all tasks; beyond, pieces are shuffled by split.
MANY_SPLITS = 100_000
SPACE = " \t\n\x0b\f\r"

_MARK, _STEP = np.zeros(256, bool), np.zeros(256, np.int64)
_MARK[list(b'"\\[]{}')] = True
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1

#: ``depth`` and ``least`` are given for a split that begins outside of strings, and for one that begins inside; ``least`` leaves out the last piece.
SPLITS = "file string, split long, first long, last long, pieces long, odd boolean, depth array<long>, least array<struct<depth:long,n:long,first:long,last:long>>"
_LEAST = pa.struct([(n, pa.int64()) for n in ("depth", "n", "first", "last")])
_SPLITS = pa.schema(
    [("file", pa.string()), *[(n, pa.int64()) for n in ("split", "first", "last", "pieces")], ("odd", pa.bool_()), ("depth", pa.list_(pa.int64())), ("least", pa.list_(_LEAST))]
)


def _states(texts: pa.Array, odd: bool, window: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of pieces, where each ends, whether the quotes up to there are odd, and the change of depth up to there from outside and from inside a string.

    ``window`` bytes are looked at together, so a long piece takes no more memory than its text and that.
    """
    texts = texts.cast(pa.binary()).cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    ends = bounds[1:] - bounds[0]
    odds, depths = np.full(len(ends), odd), np.zeros((2, len(ends)), np.int64)
    n_slashes, quotes, depth = 0, np.array([int(odd)]), np.zeros((2, 1), np.int64)
    for start in range(0, len(data), window):
        part = data[start : start + window]
        at = np.flatnonzero(_MARK[part])
        mark, order = part[at], np.arange(len(at))
        slash, after_slash = mark == ord("\\"), np.zeros(len(at), bool)
        after_slash[1:] = slash[:-1] & (at[1:] == at[:-1] + 1)
        begun = np.maximum.accumulate(np.where(after_slash, 0, order))
        slashes = order - begun
        if len(at) and at[0] == 0:
            slashes[begun == 0] += n_slashes
        n_slashes = int(slashes[-1]) + 1 if len(at) and slash[-1] and at[-1] == len(part) - 1 else 0
        quotes = np.concatenate([quotes[-1:] % 2, (mark == ord('"')) & (slashes % 2 == 0)]).cumsum()
        within, step = quotes[:-1] % 2 == 1, _STEP[mark]
        depth = np.concatenate([depth[:, -1:], np.where([within, ~within], 0, step)], axis=1).cumsum(axis=1)
        first, last = np.searchsorted(ends, [start, start + len(part)], "right")
        passed = np.searchsorted(at, ends[first:last] - start)
        odds[first:last], depths[:, first:last] = quotes[passed] % 2 == 1, depth[:, passed]
    return data, ends, odds, depths


def _runs(n: int, *changes: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.unique(np.concatenate([[0], *changes, [n]])).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _changes(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(keys[1:] != keys[:-1]) + 1


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of each split, from its pieces in order."""
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        done, files = [], batch.column("file")
        splits, ids = (batch.column(c).to_numpy() for c in ("split", "id"))
        for a, b in _runs(len(ids), pc.run_end_encode(files).run_ends.to_numpy()[:-1], _changes(splits)):
            key = {"file": files[a].as_py(), "split": int(splits[a])}
            known = now is not None and key.items() <= now.items()
            if not known:
                done += [now] if now else []
                now = key | {"first": int(ids[a]), "pieces": 0, "odd": False, "depth": [0, 0], "least": [None, None]}
            _, _, odd, depth = _states(batch.column("value").slice(a, b - a), now["odd"])
            depth = depth + np.array(now["depth"])[:, None]
            # the last piece up to here counts when it turns out not to be the split's last
            earlier = (np.array([now["last"]]), np.array([now["odd"]]), np.array(now["depth"])[:, None]) if known else (ids[:0], odd[:0], depth[:, :0])
            settled, odds, depths = (np.concatenate([x, y], axis=-1)[..., :-1] for x, y in zip(earlier, (ids[a:b], odd, depth), strict=True))
            for begins_inside in (0, 1):
                outside = odds == bool(begins_inside)
                there, at = depths[begins_inside][outside], settled[outside]
                old = now["least"][begins_inside]
                if len(there) and (old is None or there.min() <= old["depth"]):
                    hit = at[there == there.min()]
                    new = {"depth": int(there.min()), "n": len(hit), "first": int(hit[0]), "last": int(hit[-1])}
                    if old and old["depth"] == new["depth"]:
                        new |= {"n": new["n"] + old["n"], "first": old["first"]}
                    now["least"][begins_inside] = new
            now |= {"last": int(ids[b - 1]), "pieces": now["pieces"] + b - a, "odd": bool(odd[-1]), "depth": depth[:, -1].tolist()}
        if done:
            yield pa.RecordBatch.from_pylist(done, _SPLITS)
    if now:
        yield pa.RecordBatch.from_pylist([now], _SPLITS)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items that begin and end in one split, from its pieces in order: (file, position, text)."""
    first, state, seen = None, {"pieces": 0}, 0
    moved = ValueError("the files were split otherwise in the second pass")
    for batch in batches:
        if not batch.num_rows:
            continue
        firsts = batch.column("first").to_numpy()
        for a, b in _runs(len(firsts), _changes(firsts)):
            if firsts[a] != first:
                if seen != state["pieces"] or not batch.column("state")[a].is_valid:
                    raise moved
                first, state, seen = firsts[a], batch.column("state")[a].as_py(), 0
                odd, depth0, position, whole, held = False, state["depth"], state["base"], state["is_first"], []
            data, ends, odds, depth = _states(batch.column("value").slice(a, b - a), odd)
            depth = depth[int(state["inside"])] + depth0
            odd, depth0, seen = bool(odds[-1]), int(depth[-1]), seen + b - a
            closes = (odds == state["inside"]) & (depth == 1)
            closes[-1] &= not (state["is_last"] and seen == state["pieces"])
            stops = ends[closes]
            if not len(stops):
                held += [data.tobytes()] if whole else []
                continue
            text = b"".join([*held, data[: stops[-1]].tobytes()])
            # without what is held, the first one may have begun in a split before
            bounds = np.concatenate([[0], stops + sum(map(len, held))])[0 if whole else 1 :].astype(np.int32)
            position += not whole
            whole, held, n = True, [data[stops[-1] :].tobytes()], len(bounds) - 1
            found = pa.StringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(state["file"]), n), pa.array(np.arange(position, position + n)), found], names=["file", "position", "text"])
            position += n
    if seen != state["pieces"]:
        raise moved


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, text) of the items of JSON arrays, one array a file; every item must be an object.

    ``text`` is the item's own text. A file that does not begin with ``[``, or does not end where its array does, ends the job with an error that names
    it; so does anything but objects between commas. Empty arrays and empty files give no row. The text is read once by this call, and twice
    wherever the result is used: for the items within splits, and for those at their edges.
    """
    pieces = read_pieces(spark, path, "}")
    closed = pieces.withColumn("value", F.concat("value", F.lit("}")))
    found = closed.mapInArrow(_splits, SPLITS)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0))

    starts = found.withColumn("n_odd", F.col("odd").cast("int")).withColumn("inside", before("n_odd") % 2 == 1)
    case = F.col("inside").cast("int")
    starts = starts.withColumn("change", F.col("depth")[case]).withColumn("least", F.col("least")[case]).withColumn("depth", before("change"))
    starts = starts.withColumn("is_first", F.first("split").over(whole_file) == F.col("split")).withColumn("is_last", F.last("split").over(whole_file) == F.col("split"))
    # after the text's last piece comes no brace, though one is counted
    outside, end, least = F.col("odd") == F.col("inside"), F.col("depth") + F.col("change"), F.col("depth") + F.col("least.depth")
    closes = F.coalesce(least == 1, F.lit(False))
    last_closes = ~F.col("is_last") & outside & (end == 1)
    sound = F.coalesce(least >= 1, F.lit(True)) & F.when(F.col("is_last"), outside & (end == -1)).otherwise(~outside | (end >= 1))
    starts = starts.select(
        "file", "split", "first", "last", "pieces", "inside", "depth", "is_first", "is_last", F.min(sound).over(whole_file).alias("sound"),
        (F.when(closes, F.col("least.n")).otherwise(0) + last_closes.cast("int")).alias("n_items"),
        F.when(closes, F.col("least.first")).when(last_closes, F.col("last")).alias("first_close"),
        F.when(last_closes, F.col("last")).when(closes, F.col("least.last")).alias("last_close"),
    )
    starts = cut(starts.withColumn("base", before("n_items")), "starts")
    rows = join_small(pieces, starts, ["file", "split"], max_rows=MANY_SPLITS)
    if starts.count() > MANY_SPLITS:
        rows = rows.repartition("file", "split").sortWithinPartitions("first", "id")
    bad = ~F.col("sound") | (F.col("is_first") & ~F.col("value").rlike(r"^\s*\["))
    named = F.when(bad, F.raise_error(F.concat(F.col("file"), F.lit(": not a JSON array of objects")))).otherwise(F.col("file")).alias("file")
    state = F.when(F.col("id") == F.col("first"), F.struct(named, "base", "is_first", "is_last", "inside", "depth", "pieces")).alias("state")
    moved = F.raise_error(F.concat(F.lit("the files were split otherwise in the second pass: "), F.col("file"))).cast("long")
    value = F.when(F.col("is_last") & (F.col("id") == F.col("last")), F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("value")
    within = rows.select(F.coalesce("first", moved).alias("first"), state, value).mapInArrow(_items, "file string, position long, text string")
    # of other splits than a file's first, the first item may have begun before
    tail = F.coalesce(F.col("id") > F.col("last_close"), F.lit(True))
    edges = rows.filter(tail | (~F.col("is_first") & (F.col("id") <= F.col("first_close"))))
    edges = edges.select("file", (F.col("base") + F.when(tail, F.col("n_items")).otherwise(0)).alias("position"), F.struct("split", "id", value).alias("piece"))
    crossing = edges.groupBy("file", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["value"]), "").alias("text"))
    items = within.unionByName(crossing)
    is_first, space = F.col("position") == 0, F.lit(SPACE)
    # only what follows a file's last item does not end with a brace
    empty = ~F.col("text").endswith("}") & F.when(is_first, F.col("text").rlike(r"^\s*\[\s*\]\s*\z")).otherwise(F.trim("text", space) == "]")
    items = items.filter(~empty).withColumn("text", F.ltrim("text", space))
    items = items.withColumn("body", F.ltrim(F.expr("substr(text, 2)"), space))
    right = F.col("text").startswith(F.when(is_first, "[").otherwise(",")) & F.col("body").startswith("{") & F.try_parse_json("body").isNotNull()
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(": item "), F.col("position").cast("string"), F.lit(" is no object"))).cast("string")
    return items.select("file", "position", F.when(right, F.col("body")).otherwise(wrong).alias("text"))
