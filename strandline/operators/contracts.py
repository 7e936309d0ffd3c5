"""Contracts of records: violations as a column, strict checks, duplicate ids.

Where a check in a script would raise on the first fault, these columns list all faults of a row, so that bad
rows can be set aside; ``strict`` raises in the job on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.variants import as_map, kind_of, once

# fixed values: the schema ids that records carry
AUDIO_SCHEMA = "lse.audio_manifest.v2"
SFT_SCHEMA = "lse.sft.v2"
DPO_SCHEMA = "lse.dpo.v2"
GRPO_SCHEMA = "lse.grpo.v2"
SPLITS = ("train", "eval", "test", "unassigned")
ROLES = ("system", "user", "assistant")
BLANKS = " \t\n\r\x0b\x0c"


def _faults(*checks: tuple[Column, str]) -> Column:
    """The messages of all checks whose condition holds."""
    found = F.array(*[F.when(condition, F.lit(message)) for condition, message in checks])
    return F.filter(found, lambda x: x.isNotNull())


#: Fields of a manifest record with the kind of value that each must be.
REQUIRED = {
    "sample_id": "string", "audio": "object", "audio.noisy_path": "string", "audio.sample_rate": "integer", "acoustics": "object", "acoustics.noise_type": "string",
    "target": "object", "target.diagnosis": "object", "target.actions": "array", "target.rationale": "string",
}
NUMERIC = ("missing", "null", "integer", "number", "boolean")


def _name(path: str) -> str:
    return path.replace(".", "_")


def _required(v: Column, path: str) -> list[tuple[Column, str]]:
    k, wanted = v[_name(path)], REQUIRED[path]
    parent = path.rpartition(".")[0]
    reachable = v[_name(parent)] == "object" if parent else F.lit(True)
    wrong = ~k.isin("integer", "boolean") if wanted == "integer" else k != wanted
    return [(reachable & (k == "missing"), f"{path}: missing"), (reachable & (k != "missing") & wrong, f"{path}: not {wanted}")]


def _audio_checks(v: Column) -> Column:
    checks = [
        (F.coalesce(v["schema"] != AUDIO_SCHEMA, F.lit(True)), "schema_version"),
        *_required(v, "sample_id"),
        *_required(v, "audio"),
        *_required(v, "audio.noisy_path"),
        *_required(v, "audio.sample_rate"),
        (~v["rate"].between(8000, 192000) | (v["audio_sample_rate"] == "boolean"), "audio.sample_rate: outside [8000, 192000]"),
        (~v["k_duration"].isin(*NUMERIC) | (v["duration"] <= 0), "audio.duration_seconds: not positive"),
        *_required(v, "acoustics"),
        *_required(v, "acoustics.noise_type"),
        (F.btrim(v["noise"], F.lit(BLANKS)) == "", "acoustics.noise_type: empty"),
        (~v["k_snr"].isin(*NUMERIC) | ~v["snr"].between(-30, 80), "acoustics.snr_db: outside [-30, 80]"),
        *_required(v, "target"),
        *_required(v, "target.diagnosis"),
        *_required(v, "target.actions"),
        (v["n_actions"] == 0, "target.actions: empty"),
        *_required(v, "target.rationale"),
        ((v["k_split"] != "missing") & ~F.coalesce(v["split"].isin(*SPLITS), F.lit(False)), "split: unknown"),
    ]
    return _faults(*checks)


#: Fields that are looked up besides the required ones.
OTHERS = ("schema_version", "split", "audio.duration_seconds", "acoustics.snr_db")


def audio_violations(record: Column) -> Column:
    """Faults of a manifest record given as a VARIANT column. Each object is opened once, and each field looked up once in it."""

    def opened(top: Column) -> Column:
        return F.struct(top.alias("top"), *[as_map(F.element_at(top, n)).alias(n) for n in ("audio", "acoustics", "target")])

    def fields(o: Column) -> Column:
        at = {path: F.element_at(o[path.rpartition(".")[0] or "top"], path.rpartition(".")[2]) for path in (*REQUIRED, *OTHERS)}
        return F.struct(o["top"].isNotNull().alias("object"), *[v.alias(_name(path)) for path, v in at.items()])

    def looked(f: Column) -> Column:
        out = {_name(path): kind_of(f[_name(path)]) for path in REQUIRED}
        out |= {f"k_{n}": kind_of(f[c]) for n, c in (("duration", "audio_duration_seconds"), ("snr", "acoustics_snr_db"), ("split", "split"))}
        out |= {n: F.try_variant_get(f[c], "$", "string") for n, c in (("schema", "schema_version"), ("noise", "acoustics_noise_type"), ("split", "split"))}
        out |= {n: F.try_variant_get(f[c], "$", "double") for n, c in (("rate", "audio_sample_rate"), ("duration", "audio_duration_seconds"), ("snr", "acoustics_snr_db"))}
        out["n_actions"] = F.size(F.try_variant_get(f["target_actions"], "$", "array<variant>"))
        return F.struct(f["object"].alias("object"), *[c.alias(n) for n, c in out.items()])

    def faults(v: Column) -> Column:
        return F.when(v["object"], _audio_checks(v)).otherwise(F.array(F.lit("record: not object")))

    return once(once(once(once(as_map(record), opened), fields), looked), faults)


def message_violations(messages: Column, need_assistant: bool) -> Column:
    """Faults of an array of (role, content)."""
    blank = F.exists(messages, lambda m: F.coalesce(F.btrim(m["content"], F.lit(BLANKS)) == "", F.lit(True)))
    role = F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    checks = [
        (F.coalesce(F.size(messages) == 0, F.lit(True)) | messages.isNull(), "messages: empty"),
        (F.exists(messages, lambda m: m.isNull()), "message: not object"),
        (role, "message: invalid role"),
        (blank, "message: empty content"),
    ]
    if need_assistant:
        checks.append((~F.exists(messages, lambda m: m["role"] == "assistant"), "messages: no assistant"))
    return _faults(*checks)


def alignment_violations(schema: Column, fields: dict[str, Column]) -> Column:
    """Faults of a derived record, by its schema id; ``fields`` names the columns that there are."""

    def messages(name: str, need: bool) -> Column:
        if name not in fields:
            return F.array(F.lit(f"{name}: missing"))
        return F.transform(message_violations(fields[name], need), lambda x: F.concat(F.lit(f"{name}: "), x))

    def present(name: str) -> Column:
        return F.when(fields[name].isNull(), F.array(F.lit(f"{name}: missing"))).otherwise(F.array()) if name in fields else F.array(F.lit(f"{name}: missing"))

    return (
        F.when(schema == SFT_SCHEMA, messages("messages", True))
        .when(schema == DPO_SCHEMA, F.concat(messages("prompt", False), messages("chosen", True), messages("rejected", True), present("preference")))
        .when(schema == GRPO_SCHEMA, F.concat(messages("prompt", False), present("ground_truth"), present("reward_context")))
        .otherwise(F.array(F.lit("schema_version: unsupported")))
    )


def duplicate_ids(rows: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, n) of ids that occur more than once."""
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def strict(rows: DataFrame, violations_col: str = "violations") -> DataFrame:
    """``rows``, in whose job any violation raises an error with its messages."""
    v = F.col(violations_col)
    checked = F.when(F.size(v) > 0, F.raise_error(F.array_join(v, "; ")).cast("array<string>")).otherwise(v)
    return rows.withColumn(violations_col, checked)


def missing_files(rows: DataFrame, listing: DataFrame, path_col: str = "noisy_path") -> DataFrame:
    """Rows whose file is not in a listing of paths."""
    return rows.join(listing.select(F.col("path").alias(path_col)), path_col, "left_anti")


__all__ = ["alignment_violations", "audio_violations", "duplicate_ids", "message_violations", "missing_files", "strict"]
