"""Deterministic split of unassigned rows by hash rank, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGNED = ("train", "eval", "test")


def kth_hash(hashes: DataFrame, k: int, most: int = 10_000, digits: int = 3) -> str:
    """The ``k``-th least of the hex strings ``h``.

    Rows are counted by their first digits, which tells the group that the k-th lies in; only a group of at most
    ``most`` rows is sorted, and a larger one is counted by some digits more. No task sorts a share of the table.
    """
    depth = 0
    while True:
        depth += digits
        counts = hashes.groupBy(F.substring("h", 1, depth).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        for p, n in counts:
            if k <= n:
                break
            k -= n
        hashes = hashes.filter(F.col("h").startswith(p))
        if n <= most or depth >= 64:
            return hashes.orderBy("h").limit(k).agg(F.max("h")).first()[0]


def deterministic_split(rows: DataFrame, seed: int, eval_ratio: float, id_col: str = "sample_id", split_col: str = "split") -> DataFrame:
    """``rows`` with every split assigned.

    Rows that are neither train, eval nor test are ranked by sha256 of ``seed:id``; as many of the first
    become eval as it takes to reach the share (half to even, one at least), the others train. One
    aggregate gives the counts, and counts by the first digits of the hash the last chosen row.
    """
    if not 0 <= eval_ratio < 1:
        raise ValueError("eval_ratio must be in [0, 1)")
    split, rank = F.col(split_col), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    open_row = ~F.coalesce(split.isin(*ASSIGNED), F.lit(False))
    n, n_eval, n_open = rows.agg(F.count("*"), F.count_if(split == "eval"), F.count_if(open_row)).first()
    target = round(n * eval_ratio)
    if eval_ratio > 0 and n >= 2:
        target = max(1, target)
    k = min(n_open, max(0, target - n_eval))
    if k == 0:
        chosen = F.lit(False)
    else:
        # ids are unique, so the hash of the k-th row parts the chosen from the others
        last = kth_hash(rows.filter(open_row).select(rank.alias("h")), k)
        chosen = rank <= last
    return rows.withColumn(split_col, F.when(~open_row, split).when(chosen, "eval").otherwise("train"))


def split_counts(rows: DataFrame, stage_col: str = "stage", split_col: str = "split") -> DataFrame:
    """Rows of each stage in each split, with zeros."""
    return rows.groupBy(stage_col).pivot(split_col, list(ASSIGNED)).count().na.fill(0, list(ASSIGNED))
