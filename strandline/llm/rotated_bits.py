"""Hard negatives by rotated one-bit codes with stored alignment and deterministic intervals.

Vectors become integers, are rotated by one random orthogonal matrix, and keep the signs of their components: a code s of unit
length, with the alignment a = <x, s> and the length of what is left, |x - a s|. What is left has a code of its own at
the next level (``levels`` of them). For an anchor q the products of the signs with the rotated q, weighted by the alignments, give <x, q>
but for the product of q with what the codes leave, which Cauchy and Schwarz bound by |q| times the stored length. They are taken in single
precision, for many pairs at once, and intervals are widened by more than its rounding. Rows whose interval misses what an anchor still
wants are dropped, the others are scored in integers. So no row is lost, and no estimate is returned.

On Spark the anchors, a stated query set, meet all rows in blocks: a task has one block of anchors (``anchor_block`` of them at most
on average) and streams the packed rows of one part of the table past it, keeping the best few of each anchor. A first pass finds the
positives of every anchor, a second one its negatives; the best of all parts are ranked by a window of (places * parts) rows
for each anchor. There are about as many parts as the root of the number of rows. Labels play no part in how rows are dealt.

No part take rows with a null id, label or vector, with no component, or with one that is null or not finite, and for an anchor the
rows whose number of components is not its own. Equal anchors are one; anchors of the same id that differ in label or vector all answer. A row
is never a positive or negative of its own id; repeated rows count as often as they stand. Ties go to the smaller id. A
vector whose integers have a squared length of 2**56 or more ends the job with an error, as scores would not fit into 64 bits. An empty table, or one
without anchors, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.plans.runtime import cut, discard

#: Relative error of single precision, with room, for each component of a product.
SLACK = 2.0**-21
CHUNK = 256
PROBES, FEW = 16, 64
PACKED = "dims int, ids array<long>, labels array<long>, data binary, codes binary, aligned binary, rest binary"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@lru_cache(8)
def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task but for rounding, which the slack of the intervals covers."""
    return np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))[0]


def _rotated(x: np.ndarray) -> np.ndarray:
    """Rows rotated in as many dimensions as fill whole 64-bit words."""
    width = -(-x.shape[1] // 64) * 64
    return np.pad(x.astype(float), ((0, 0), (0, width - x.shape[1]))) @ rotation(width).T


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (level, row, word), alignments and lengths of what is left (level, row)."""
    left = _rotated(x)
    codes, aligned, rest = [], [], []
    for _ in range(levels):
        positive = left > 0
        sign = np.where(positive, 1.0, -1.0) / math.sqrt(left.shape[1])
        a = (left * sign).sum(axis=1)
        left = left - a[:, None] * sign
        codes.append(_words(positive)), aligned.append(a), rest.append(np.sqrt((left * left).sum(axis=1)))
    return np.stack(codes), np.stack(aligned), np.stack(rest)


class Anchors:
    """Anchors of equal dimension, with their rotated vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        x = _rotated(vectors)
        self.length = np.sqrt((x * x).sum(axis=1)).astype(np.float32)
        self.rotated = x.astype(np.float32)


class Intervals:
    """The products of pairs (anchor, row), narrowed level by level."""

    def __init__(self, anchors: Anchors, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray):
        self.anchors = anchors
        signs = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=-1, bitorder="little")
        width = signs.shape[-1]
        # what the codes up to each level say of a row
        self.known = np.cumsum((signs * 2.0 - 1) * (aligned / math.sqrt(width))[..., None], axis=0).astype(np.float32)
        size = np.sqrt(aligned[0] ** 2 + rest[0] ** 2)
        self.rest = (rest + SLACK * (width + 8) * size).astype(np.float32)

    def _bounds(self, level: int, i: np.ndarray, j: np.ndarray | slice | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the anchors ``i`` with all rows, with those of a slice, or with as many rows ``j``."""
        q, known, rest, length = self.anchors.rotated[i], self.known[level], self.rest[level], self.anchors.length[i]
        if isinstance(j, np.ndarray):
            mid, width = np.einsum("ij,ij->i", q, known[j]), rest[j] * length
        else:
            of = j or slice(None)
            mid, width = q @ known[of].T, length[:, None] * rest[of]
        width += np.float32(1e-3)
        return mid - width, mid + width

    def _first(self, i: np.ndarray, allowed: np.ndarray, wanted) -> int:
        """The first level that leaves few pairs, by some anchors and rows: levels before it are not worth a look."""
        if len(i) < 8 * PROBES:
            return 0
        some, of = np.arange(0, len(i), len(i) // PROBES), slice(None, None, 8)
        sure = allowed[some][:, of]
        for level in range(len(self.rest) - 1):
            if 16 * np.count_nonzero(sure & wanted(i[some][:, None], *self._bounds(level, i[some], of))) <= np.count_nonzero(sure):
                return level
        return len(self.rest) - 1

    def survivors(self, i: np.ndarray, allowed: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) of the anchors ``i`` that are ``allowed`` and that ``wanted`` (anchors, lower, upper) keeps at every level.

        While many pairs are left, a level is one product of matrices, then it is looked at for the pairs that are left.
        """
        top, j = len(self.rest), None
        for level in range(self._first(i, allowed, wanted), top):
            if j is None:
                allowed = allowed & wanted(i[:, None], *self._bounds(level, i))
                if level + 2 >= top or 16 * np.count_nonzero(allowed) <= allowed.size:
                    at, j = np.nonzero(allowed)
                    i = i[at]
            else:
                keep = wanted(i, *self._bounds(level, i, j))
                i, j = i[keep], j[keep]
        return i, j


class Best:
    """The ``k`` greatest scores of each group, ties by the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((groups, k), np.int64), np.zeros((groups, k), np.int64)
        self.filled = np.zeros((groups, k), bool)
        self.least = np.full(groups, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fit = score >= self.least[group]
        group, score, ids = group[fit], score[fit], ids[fit]
        if not len(group):
            return
        touched = np.unique(group)
        at, place = np.nonzero(self.filled[touched])
        old = touched[at]
        group, score, ids = np.concatenate([old, group]), np.concatenate([self.score[old, place], score]), np.concatenate([self.id[old, place], ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        kept = place < self.k
        at = (group[kept], place[kept])
        self.score[at], self.id[at], self.filled[at] = score[kept], ids[kept], True
        full = place == self.k - 1
        self.least[group[full]] = score[full]


def _packer(levels: int, block: int, scale: int):
    """Rows (id, label, vector) as blocks of equal dimension: integers, codes, alignments."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for dims in np.unique(sizes).tolist():
                of = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                for start in range(0, of.num_rows, block):
                    part = of.slice(start, block)
                    x = np.floor(scale * part.column("vector").flatten().to_numpy()).reshape(-1, dims)
                    if (x * x).sum(axis=1).max() >= 2.0**56:
                        raise ValueError("a vector is too long for scores of 64 bits")
                    columns = [[v] for v in (x.astype(np.int32).tobytes(), *(v.tobytes() for v in encode(x, levels)))]
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("id", "label")]
                    names = [f.split(" ")[0] for f in PACKED.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *lists, *[pa.array(c, pa.binary()) for c in columns]], names=names)

    return pack


def _scores(anchors: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
    """Integer products of pairs of rows, so many numbers at once."""
    out, rows = np.empty(len(i), np.int64), max(1, at_once // x.shape[1])
    for a in range(0, len(i), rows):
        out[a : a + rows] = np.einsum("ij,ij->i", anchors[i[a : a + rows]], x[j[a : a + rows]].astype(np.int64))
    return out


def _search(levels: int, k: int, low: int, high: int):
    """Tasks (task, anchors first, then packed rows) to their best rows (anchor, place, score, id).

    Without ``wanted`` scores the rows of the anchor's label are wanted. With them those of other labels, whose hundredfold score lies within
    ``low`` and ``high`` times each wanted score; ``place`` is that of the wanted score.
    """

    def of_task(anchors: list[dict]) -> tuple:
        groups = {}
        for dims in {len(a["vector"]) for a in anchors}:
            own = [a for a in anchors if len(a["vector"]) == dims]
            places = max(len(a["wanted"]) if a["wanted"] is not None else 1 for a in own)
            floor, top = (np.full((len(own), places), v) for v in (math.inf, -math.inf))
            goal = np.zeros((len(own), places), np.int64)
            for n, a in enumerate(own):
                if a["wanted"] is None:
                    floor[n], top[n] = -math.inf, math.inf
                for p, score in enumerate(a["wanted"] or []):
                    goal[n, p] = score
                    floor[n, p], top[n, p] = low * score / 100 - 1, high * score / 100 + 1
            numbers = {c: np.array([a[c] for a in own], np.int64) for c in ("anchor", "id", "label")}
            groups[dims] = (Anchors(np.array([a["vector"] for a in own], np.int64)), numbers, floor, top, goal, own[0]["wanted"] is None, Best(len(own) * places, k))
        return groups

    def meet(group: tuple, row: dict, seen: int) -> None:
        n = len(row["ids"])
        x = np.frombuffer(row["data"], np.int32).reshape(n, row["dims"])
        codes = np.frombuffer(row["codes"], np.uint64).reshape(levels, n, -1)
        aligned, rest = (np.frombuffer(row[c], np.float64).reshape(levels, n) for c in ("aligned", "rest"))
        ids, labels = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64)
        start = 0
        while start < n:
            # few rows at first, as nothing is known yet of the best
            of = slice(start, start + max(FEW, seen + start))
            meet_some(group, x[of], codes[:, of], aligned[:, of], rest[:, of], ids[of], labels[of])
            start = of.stop

    def meet_some(group: tuple, x: np.ndarray, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        anchors, numbers, floor, top, goal, same, best = group
        places = floor.shape[1]
        intervals = Intervals(anchors, codes, aligned, rest)
        highest = np.nextafter(top.max(axis=1).astype(np.float32), np.float32(np.inf))
        for start in range(0, len(numbers["id"]), CHUNK):
            i = np.arange(start, min(start + CHUNK, len(numbers["id"])))
            # of all places together; each is held against the scores below
            lowest = np.maximum(floor[i], best.least.reshape(-1, places)[i]).min(axis=1).astype(np.float32)
            lowest = np.nextafter(lowest, np.float32(-np.inf))

            def wanted(i: np.ndarray, lower: np.ndarray, upper: np.ndarray, lowest=lowest, start=start) -> np.ndarray:
                return (upper >= lowest[i - start]) & (lower <= highest[i])

            allowed = ((numbers["label"][i][:, None] == labels) == same) & (numbers["id"][i][:, None] != ids)
            i, j = intervals.survivors(i, allowed, wanted)
            score = _scores(anchors.vectors, x, i, j)
            found = []
            for p in range(places):
                fit = score >= best.least[i * places + p]
                if not same:
                    fit &= (low * goal[i, p] <= 100 * score) & (100 * score <= high * goal[i, p]) & np.isfinite(floor[i, p])
                found.append((i[fit] * places + p, score[fit], ids[j[fit]]))
            best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def answers(groups: dict) -> Iterator[pa.RecordBatch]:
        for _, numbers, floor, _, _, _, best in groups.values():
            of, place = np.divmod(np.nonzero(best.filled)[0], floor.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(numbers["anchor"][of]), pa.array(place.astype(np.int32)), pa.array(best.score[best.filled]), pa.array(best.id[best.filled])], names=["anchor", "place", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, anchors, groups, seen = None, [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["task"] != task:
                    yield from answers(groups or {})
                    task, anchors, groups, seen = row["task"], [], None, 0
                if row["ids"] is None:
                    anchors.append(row)
                    continue
                groups = of_task(anchors) if groups is None else groups
                if row["dims"] in groups:
                    meet(groups[row["dims"]], row, seen)
                    seen += len(row["ids"])
        yield from answers(groups or {})

    return run


def _tasks(anchors: DataFrame, packed: DataFrame, n_blocks: int, parts: int) -> DataFrame:
    """Each block of anchors with each part of the packed rows, anchors first."""
    own = F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int")
    each = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), own.alias("own"), "anchor", "id", "label", "vector", "wanted")
    all_blocks = packed.select("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("own"), *[f.split(" ")[0] for f in PACKED.split(", ")])
    both = each.unionByName(all_blocks, allowMissingColumns=True)
    both = both.withColumn("task", F.col("own") * F.lit(parts).cast("long") + F.col("part")).drop("own", "part")
    return both.repartition("task").sortWithinPartitions("task", F.col("ids").isNotNull())


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    levels: int = 4,
    anchor_block: int = 8192,
    block: int = 1024,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row that ``is_anchor``.

    Components become floor(``scale`` * x); a score is the integer inner product with the anchor, higher ones come first. Its positives are the
    first ``positives`` other rows of its label; for each the first ``negatives`` rows of other labels are returned with
    ``low`` * positive_score <= 100 * negative_score <= ``high`` * positive_score.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    named = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~bad)
    integers = F.transform("vector", lambda x: F.floor(x * scale).cast("int"))
    asked = usable.filter("asks").select("id", "label", integers.alias("vector")).distinct()
    asked = cut(asked.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    packed = cut(usable.drop("asks").mapInArrow(_packer(levels, block, scale), PACKED), "packed")
    n = packed.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    n_blocks, parts = max(1, -(-asked.count() // anchor_block)), max(1, math.isqrt(n // 64))
    # dealt evenly by what stands in a block, not by its rows
    dealt = packed.withColumn("part", F.pmod(F.xxhash64(F.element_at("ids", 1), "data"), F.lit(parts)).cast("int"))

    def best(anchors: DataFrame, k: int) -> DataFrame:
        found = _tasks(anchors, dealt, n_blocks, parts).mapInArrow(_search(levels, k, low, high), "anchor long, place int, score long, id long")
        nth = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", nth).filter(F.col("rank") <= k)

    none = asked.withColumn("wanted", F.lit(None).cast("array<long>"))
    near = best(none, positives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("near"))
    near = cut(asked.join(near, "anchor"), "positives")
    found = best(near.withColumn("wanted", F.transform("near", lambda p: p["score"])), negatives)
    positive = F.element_at("near", F.col("place") + 1)
    out = found.join(near.select("anchor", F.col("id").alias("anchor_id"), "near"), "anchor")
    out = out.select("anchor_id", positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
    out = cut(out, "negatives")
    discard(asked, packed, near)
    return out
