"""Summaries of training and generation runs that are kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loss_series(losses: DataFrame, run_col: str = "run", step_col: str = "step", loss_col: str = "loss") -> DataFrame:
    """First, last and mean loss of each run, how many there are, and whether all are finite."""
    loss, step = F.col(loss_col), F.col(step_col)
    finite = ~F.isnan(loss) & (F.abs(loss) < float("inf"))
    return losses.groupBy(run_col).agg(
        F.count("*").alias("optimizer_steps"),
        F.min_by(loss, step).alias("initial_loss"),
        F.max_by(loss, step).alias("final_loss"),
        F.avg(loss).alias("mean_loss"),
        F.bool_and(F.coalesce(finite, F.lit(False))).alias("all_losses_finite"),
    )


def throughput(records: Column, seconds: Column) -> Column:
    """Records a second, and null for no time."""
    return records / F.nullif(seconds.cast("double"), F.lit(0.0))


def cross_entropy(log_probs: Column) -> Column:
    """The negative sum of token log-probabilities."""
    return -F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x)


def missing_answers(dataset: DataFrame, predictions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Rows of a dataset for which no answer was generated."""
    return dataset.join(predictions.select(id_col), id_col, "left_anti")


def table_digest(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: number of rows and an order-free digest of their contents, as provenance of a table."""
    names = sorted(columns or rows.columns)
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(part.alias("d")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("d"), F.lit(0)).cast("string").alias("digest"))
