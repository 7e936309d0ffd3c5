"""Exact k-means in integers: bounded vectors, and a search of sorted neighbours in a shrinking ball.

Every vector keeps its centroid, the second-nearest one it met last, an upper bound of the distance to the first and a
lower bound of that to all others. Moved centroids loosen the bounds by what they moved. A vector whose upper
bound is below its lower bound, or below half the distance from its centroid to the nearest other one, needs no look at all.
The others measure both remembered centroids and start from the closer one: its neighbours are scanned in order of
their distance from it, as far as the ball reaches whose radius is the distance to the start plus that to the
second-nearest so far. Each nearer centroid that is met shrinks the ball. What survives is compared by exact integer
distances, ties going to the smaller number; bounds are floating point and widened, so they only ever cost a comparison.

On Spark the integer vectors are written once, in blocks, bucketed by block. A round joins the blocks with the small
state of the round before (some 20 bytes a vector, the only thing that crosses the network), and writes the new state with the change of
each centroid's sum and count. These changes are added up within each task, then over the tasks: k * (components + 1)
numbers reach the driver, however many vectors there are. No vector is shuffled by its cluster, so a cluster may
hold any share of all rows. The centroids (k * components numbers, bounded by the parameters) are sent to all tasks.

Kept are vectors with exactly ``dims`` components, none of them null or not finite; other rows are not in the result.
A component beyond 2**26 after scaling ends the job with an error, as distances would not fit into 64 bits. A null id
is carried through; it is no start unless there are too few others. Repeated rows are kept as often as they stand; equal
starts are different centroids, of which the smaller number wins all ties. With fewer than ``k`` vectors there
is one centroid for each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.bytetext import bytes_of
from strandline.plans.runtime import cut, discard, shared_dir

LIMIT = 1 << 26
SLACK = 1e-9
STATE = "block long, best binary, second binary, upper binary, lower binary, measured long, moved array<struct<cluster:int,n:long,sums:array<long>>>"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``c``, one row or as many."""
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


class Centroids:
    """The centroids of a round with what the search needs: distances between them, neighbours in order, and what they moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now, self.k = now, len(now)
        self.apart = np.sqrt(np.stack([_distances(now, c) for c in now]).astype(float))
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        others = self.apart + np.diag(np.full(self.k, np.inf))
        self.half = others.min(axis=1) / 2
        moved = np.zeros(self.k) if before is None else np.sqrt(_distances(now, before).astype(float)) * (1 + SLACK)
        self.moved = moved
        top = np.sort(moved)[::-1]
        self.moved_others = np.where((moved == top[0]) & (np.arange(self.k) == moved.argmax()), top[1] if self.k > 1 else 0.0, top[0])

    def assign(self, x: np.ndarray, best: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring the state of the rows of ``x`` to these centroids, in place; the number of distances that were measured."""
        if self.k == 1:
            return 0
        upper += self.moved[best]
        lower -= self.moved_others[best]
        at = np.flatnonzero(~(upper < np.maximum(lower, self.half[best]) * (1 - SLACK)))
        if not len(at):
            return 0
        d1 = _distances(x[at], self.now[best[at]])
        measured = len(at)
        upper[at] = np.sqrt(d1.astype(float)) * (1 + SLACK)
        open_ = ~(upper[at] < np.maximum(lower[at], self.half[best[at]]) * (1 - SLACK))
        at, d1 = at[open_], d1[open_]
        if not len(at):
            return measured
        rows, first, other = x[at], best[at], second[at]
        d2 = _distances(rows, self.now[other])
        measured += len(at)
        swap = (d2 < d1) | ((d2 == d1) & (other < first))
        first, other = np.where(swap, other, first), np.where(swap, first, other)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, known = first.copy(), other.copy()
        reach = np.sqrt(d1.astype(float))
        inside = np.arange(len(at))
        for step in range(self.k):
            j = self.order[start[inside], step]
            ball = (reach[inside] + np.sqrt(d2[inside].astype(float))) * (1 + SLACK)
            within = self.apart[start[inside], j] <= ball
            inside, j = inside[within], j[within]
            if not len(inside):
                break
            new = (j != start[inside]) & (j != known[inside])
            i, j = inside[new], j[new]
            if not len(i):
                continue
            d = _distances(rows[i], self.now[j])
            measured += len(i)
            nearer = (d < d1[i]) | ((d == d1[i]) & (j < first[i]))
            between = ~nearer & ((d < d2[i]) | ((d == d2[i]) & (j < other[i])))
            hit = i[nearer]
            other[hit], d2[hit] = first[hit], d1[hit]
            first[hit], d1[hit] = j[nearer], d[nearer]
            other[i[between]], d2[i[between]] = j[between], d[between]
        best[at], second[at] = first, other
        upper[at], lower[at] = np.sqrt(d1.astype(float)) * (1 + SLACK), np.sqrt(d2.astype(float)) * (1 - SLACK)
        return measured


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(scale * values)
    if len(out) and np.abs(out).max() > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} after scaling: distances would not fit into 64 bits")
    return out.astype(np.int32)


def _packer(dims: int, scale: int, block: int):
    """Blocks of integer vectors with the ids of their rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                values = _scaled(part.column("vector").flatten().to_numpy(zero_copy_only=False), scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([values.tobytes()], pa.binary())], names=["block", "ids", "data"])
                number += 1

    return pack


def _bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``df`` written below the shared folder as a table that is bucketed by ``key``, and the table's name."""
    spark, name = df.sparkSession, f"strandline_{uuid.uuid4().hex}"
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_dir(spark)}/strandline/{name}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_at = path
    return out, name


def _numbers(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name], kind).copy()


def _stepper(centroids: Centroids, dims: int):
    """The state of each block under ``centroids``, and what its rows change in the sums of clusters."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["data"], np.int32).reshape(-1, dims).astype(np.int64)
                fresh = row["best"] is None
                if fresh:
                    best, second = np.zeros(len(x), np.int32), np.full(len(x), min(1, centroids.k - 1), np.int32)
                    upper, lower = np.full(len(x), np.inf), np.zeros(len(x))
                    was = np.full(len(x), -1, np.int32)
                else:
                    best, second = _numbers(row, "best", np.int32), _numbers(row, "second", np.int32)
                    upper, lower = _numbers(row, "upper", np.float64), _numbers(row, "lower", np.float64)
                    was = best.copy()
                measured = centroids.assign(x, best, second, upper, lower)
                left, moved = was != best, []
                for c in np.unique(np.concatenate([best[left], was[left & (was >= 0)]])).tolist():
                    to, away = left & (best == c), left & (was == c)
                    moved.append({"cluster": c, "n": int(to.sum()) - int(away.sum()), "sums": (x[to].sum(axis=0) - x[away].sum(axis=0)).tolist()})
                state = {"block": row["block"], "best": best.tobytes(), "second": second.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "measured": measured, "moved": moved}
                yield pa.RecordBatch.from_pylist([state], _STATE)

    return step


_STATE = pa.schema(
    [
        ("block", pa.int64()),
        *[(c, pa.binary()) for c in ("best", "second", "upper", "lower")],
        ("measured", pa.int64()),
        ("moved", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
    ]
)


def _gathered(dims: int):
    """The changes of all blocks of a task, added up by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for moved in batch.column("moved").to_pylist():
                for m in moved:
                    own = total.setdefault(m["cluster"], np.zeros(dims + 1, np.int64))
                    own += [m["n"], *m["sums"]]
        columns = [pa.array(total, pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "sums"])

    return run


def _assigned(centroids: Centroids, dims: int):
    """(vec_id, cluster, distance) of every row of the last state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, best in zip(batch.column("ids"), batch.column("data"), batch.column("best"), strict=True):
                x = np.frombuffer(data.as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
                cluster = np.frombuffer(best.as_buffer(), np.int32)
                distance = _distances(x, centroids.now[cluster])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _changes(state: DataFrame, dims: int) -> dict[tuple[int, int], int]:
    """For each cluster and place (0: the number of rows, then the components) how much its sum changes."""
    by_task = state.select("moved").mapInArrow(_gathered(dims), "cluster int, sums array<long>")
    cells = by_task.select("cluster", F.posexplode("sums").alias("place", "value")).groupBy("cluster", "place")
    return {(r["cluster"], r["place"]): int(r["total"]) for r in cells.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()}


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, all of them finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def shallot_means(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    salt: str = "3:",
    block: int = 1024,
    work: dict | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Components become floor(``scale`` * x). The ``k`` vectors with the least sha256 of ``salt`` and the id are the first centroids
    (equal ids by their components). Each of ``rounds`` rounds assigns every vector and replaces non-empty centroids by the
    componentwise floor of the mean; vectors are assigned once more at the end. Rounds that would change nothing are left out.
    ``work`` is given the number of distances measured in each assignment, besides those of the result.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    kept = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector")).filter(usable(F.col("vector"), dims))
    starts = kept.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], OUT)
    now = np.stack([_scaled(np.array(r["vector"]), scale) for r in starts]).astype(np.int64)
    blocks, name = _bucketed(kept.mapInArrow(_packer(dims, scale, block), "block long, ids array<long>, data binary"), "block")
    centroids, totals, state = Centroids(now), np.zeros((len(now), dims + 1), object), None
    for at in range(rounds + 1):
        old = blocks.select("block", "data")
        if state is None:
            old = old.withColumns({c: F.lit(None).cast("binary") for c in ("best", "second", "upper", "lower")})
        else:
            old = old.join(state.drop("measured", "moved"), "block")
        new = cut(old.mapInArrow(_stepper(centroids, dims), STATE), "clusters")
        if state is not None:
            discard(state)
        state = new
        if work is not None:
            work[at] = state.agg(F.sum("measured")).first()[0]
        if at == rounds:
            break
        for (c, place), n in _changes(state, dims).items():
            totals[c, place] += n
        new = np.array([[int(s) // int(t[0]) for s in t[1:]] if t[0] else c.tolist() for c, t in zip(now, totals, strict=True)], np.int64)
        if (new == now).all():
            break
        centroids, now = Centroids(new, now), new

    joined = blocks.join(state.select("block", "best"), "block").select("ids", "data", "best")
    out = cut(joined.mapInArrow(_assigned(centroids, dims), "vec_id long, cluster int, distance long"), "assigned")
    discard(state, blocks)
    spark.sql(f"DROP TABLE {name}")
    sums = {r["cluster"]: int(r["n"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    of_cluster = [(c, n, sum(sums.values()), digests[c]) for c, n in sums.items()]
    small = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
