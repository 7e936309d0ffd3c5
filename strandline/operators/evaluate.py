"""Evaluation of answers against a dataset: joins, means, ablations, examples, stage matrix, release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.rewards import COMPONENTS, ablation_totals

METRICS = (*COMPONENTS, "total")


def unique_predictions(predictions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, response), in whose job a repeated id, an empty one or a response that is missing raises an error."""
    per_id = predictions.groupBy(id_col).agg(F.first("response").alias("response"), F.count("*").alias("n"))
    own = F.col(id_col).cast("string")
    checked = (
        F.when(F.coalesce(own, F.lit("")) == "", F.raise_error(F.lit("prediction without an id")).cast("string"))
        .when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated prediction: "), own)).cast("string"))
        .when(F.col("response").isNull(), F.raise_error(F.concat(F.lit("prediction without a response: "), own)).cast("string"))
        .otherwise(F.col("response"))
    )
    return per_id.select(id_col, checked.alias("response"))


def with_predictions(dataset: DataFrame, predictions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Rows that have a prediction, with its response; others are left out, never filled in. Repeated predictions are an error."""
    return dataset.drop("response").join(unique_predictions(predictions, id_col), id_col).withColumn("source", F.lit("prediction"))


def with_references(dataset: DataFrame) -> DataFrame:
    """All rows, answered by their own expected response."""
    return dataset.withColumn("response", F.col("reward_context.expected_response")).withColumn("source", F.lit("reference"))


def unknown_ids(dataset: DataFrame, predictions: DataFrame, id_col: str = "sample_id", n: int = 10) -> DataFrame:
    """The first ``n`` ids, in order, of predictions for rows that are not in the dataset."""
    return predictions.join(dataset.select(id_col), id_col, "left_anti").select(id_col).orderBy(id_col).limit(n)


def coverage(dataset: DataFrame, predictions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row: how many rows of the dataset have a prediction."""
    marked = dataset.select(id_col).join(predictions.select(id_col, F.lit(1).alias("hit")).distinct(), id_col, "left")
    return marked.agg(F.count("hit").alias("num_samples"), F.count("*").alias("dataset_samples")).select(
        "num_samples",
        "dataset_samples",
        F.bround(F.col("num_samples") / F.nullif(F.col("dataset_samples"), F.lit(0)), 6).alias("prediction_coverage"),
        (F.col("dataset_samples") - F.col("num_samples")).alias("missing_predictions_skipped"),
    )


def metric_means() -> list[Column]:
    """Means of the scored columns, to six decimals."""
    means = [F.bround(F.avg(F.col("valid_json").cast("double")), 6).alias("valid_json_rate")]
    return means + [F.bround(F.avg(c), 6).alias(c) for c in METRICS]


def report(scored: DataFrame) -> DataFrame:
    """One row of means over all scored rows."""
    return scored.agg(F.count("*").alias("num_samples"), *metric_means())


def ablations(scored: DataFrame) -> DataFrame:
    """One row: the mean total without each component; 0 for no rows. Answers are not scored again."""
    totals = scored.select(*ablation_totals())
    return totals.agg(*[F.coalesce(F.bround(F.avg(c), 6), F.lit(0.0)).alias(c) for c in totals.columns])


def examples(scored: DataFrame, ordinal_col: str, n: int = 20) -> DataFrame:
    """The first ``n`` scored rows in the order of the dataset."""
    return scored.orderBy(ordinal_col).limit(n)


def stage_matrix(scored: DataFrame, stage_col: str = "stage") -> DataFrame:
    """Means by stage over the rows of all stages, scored in one pass."""
    return scored.groupBy(stage_col).agg(F.count("*").alias("num_samples"), *metric_means())


def hash_sample(rows: DataFrame, seed: int, n: int, id_col: str = "sample_id") -> DataFrame:
    """``n`` rows drawn uniformly and repeatably: those with the least hash of seed and id."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col)), 256)).limit(n)


def ids_digest(rows: DataFrame, ordinal_col: str, id_col: str = "sample_id") -> DataFrame:
    """One row: the sha256 of the ids joined by newlines in order. Meant for samples: it gathers their ids."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ordinal_col).alias("o"), F.col(id_col).alias("i"))))
    ids = F.transform(ordered, lambda x: x["i"])
    return rows.agg(F.size(ids).alias("records"), F.sha2(F.array_join(ids, "\n"), 256).alias("sample_ids_sha256"))


STAGES = ("base", "dpo", "grpo", "sft")


def release_gate(matrix: DataFrame, expected_records: int, stage_col: str = "stage") -> DataFrame:
    """One row: may a release go out by its stage matrix, and if not, why."""
    counts = matrix.agg(
        F.array_sort(F.collect_set(stage_col)).alias("stages"),
        F.count_if(F.col("num_samples") != expected_records).alias("wrong"),
        F.count("*").alias("n"),
    )
    complete = F.col("stages") == F.array(*map(F.lit, STAGES))
    return counts.select(
        complete.alias("stages_complete"),
        ((F.col("wrong") == 0) & (F.col("n") > 0)).alias("records_complete"),
        (complete & (F.col("wrong") == 0) & (F.col("n") == len(STAGES))).alias("accepted"),
    )


def release_faults(
    matrix: DataFrame, predictions: DataFrame, reports: DataFrame, selection: dict[str, object], expected_records: int, seed: int = 42, stage_col: str = "stage"
) -> DataFrame:
    """(fault) of everything that keeps a release back; no row if it may go out.

    ``matrix`` has the means by stage, ``predictions`` a row for each answer of a stage, ``reports`` the number
    of samples by stage (num_samples), and ``selection`` says how the sample was drawn: method, seed and digest of its ids.
    """
    spark = matrix.sparkSession
    digest = selection.get("sample_ids_sha256")
    provenance = {
        "selection: not uniform without replacement": selection.get("method") != "uniform_without_replacement",
        "selection: another seed": selection.get("seed") != seed,
        "selection: no digest of ids": not isinstance(digest, str) or len(digest) != 64,
    }
    own = spark.createDataFrame([(fault,) for fault, found in provenance.items() if found], "fault string")
    stages = spark.createDataFrame([(x,) for x in STAGES], f"{stage_col} string")
    answered = predictions.filter(F.coalesce(F.btrim("response"), F.lit("")) != "").groupBy(stage_col).agg(F.count("*").alias("n"))
    tables = {"matrix": matrix.select(stage_col, F.col("num_samples").alias("n")), "predictions": answered, "report": reports.select(stage_col, F.col("num_samples").alias("n"))}
    for name, counts in tables.items():
        each = stages.join(counts, stage_col, "left").filter(~F.col("n").eqNullSafe(F.lit(expected_records)))
        own = own.unionByName(each.select(F.concat(F.col(stage_col), F.lit(f" {name}: "), F.coalesce(F.col("n").cast("string"), F.lit("no")), F.lit(" records")).alias("fault")))
    extra = matrix.join(stages, stage_col, "left_anti").select(F.concat(F.col(stage_col), F.lit(": unknown stage")).alias("fault"))
    return own.unionByName(extra)


ARTIFACTS = ("predictions.jsonl", "reward_report.json")
ADAPTER = ("adapter_config.json", "adapter_model.safetensors")
MANIFEST, CARD, EVALUATION = "stage_manifest.json", "MODEL_CARD.md", "stage_matrix.json"
PENDING, LICENCE = "FINAL_EVAL_TABLE", "license: mit"


def package_faults(files: DataFrame, lines: DataFrame, expected_records: int, seed: int = 42) -> DataFrame:
    """(fault) of everything that keeps the files of a release back; no row if it may go out.

    ``files`` (file) names the files that there are, ``lines`` (file, line, value) has the lines of those that are text. The answers of the stages are counted
    where they stand; only the few other files, a manifest, a card, an evaluation and reports, are put together.
    """
    spark = files.sparkSession
    artifacts = [f"{stage}_{a}" for stage in STAGES for a in ARTIFACTS]
    needed = spark.createDataFrame([(f,) for f in (*ADAPTER, MANIFEST, CARD, EVALUATION, *artifacts)], "file string")
    faults = needed.join(files.select("file").distinct(), "file", "left_anti").select(F.concat("file", F.lit(": missing")).alias("fault"))

    answers = [f"{stage}_{ARTIFACTS[0]}" for stage in STAGES]
    counted = lines.filter(F.col("file").isin(answers) & F.col("value").rlike("\\S")).groupBy("file").agg(F.count("*").alias("n"))
    there = files.filter(F.col("file").isin(answers)).select("file").distinct().join(counted, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n"))
    wrong = F.concat("file", F.lit(": "), F.col("n").cast("string"), F.lit(" rows"))
    faults = faults.unionByName(there.filter(F.col("n") != expected_records).select(wrong.alias("fault")))

    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    small = needed.join(lines.filter(~F.col("file").isin(answers)), "file").groupBy("file").agg(whole.alias("text")).withColumn("v", F.try_parse_json("text"))

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("v", f"$.{path}", kind)

    def unlike(path: str, value: object, kind: str = "string") -> Column:
        return ~F.coalesce(at(path, kind) == value, F.lit(False))

    digest = at("selection.sample_ids_sha256")
    report = F.col("file").endswith(ARTIFACTS[1])
    names = F.array_sort(F.coalesce(F.map_keys(at("stages", "map<string,variant>")), F.array().cast("array<string>")))
    checks = {
        "no finished grpo run": (F.col("file") == MANIFEST) & (unlike("stage", "grpo") | unlike("status", "complete")),
        "final evaluation pending": (F.col("file") == CARD) & F.contains("text", F.lit(PENDING)),
        "no licence": (F.col("file") == CARD) & ~F.contains("text", F.lit(LICENCE)),
        "not complete": (F.col("file") == EVALUATION) & unlike("status", "complete"),
        "other stages": (F.col("file") == EVALUATION) & (names != F.array(*map(F.lit, sorted(STAGES)))),
        "other number of records": (F.col("file") == EVALUATION) & unlike("records", expected_records, "long"),
        "not uniform without replacement": (F.col("file") == EVALUATION) & unlike("selection.method", "uniform_without_replacement"),
        "another seed": (F.col("file") == EVALUATION) & unlike("selection.seed", seed, "long"),
        "no digest of ids": (F.col("file") == EVALUATION) & ~F.coalesce(F.length(digest) == 64, F.lit(False)),
        "other number of samples": report & unlike("num_samples", expected_records, "long"),
    }
    said = F.filter(F.array(*[F.when(found, F.lit(what)) for what, found in checks.items()]), lambda x: x.isNotNull())
    return faults.unionByName(small.select("file", F.explode(said).alias("what")).select(F.concat("file", F.lit(": "), "what").alias("fault")))
