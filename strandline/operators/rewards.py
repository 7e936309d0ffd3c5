"""Rule-based rewards of parsed answers, as columns.

Five components between 0 and 1 and a list of violations come from the parsed answer and its context:
noise type, signal-to-noise ratio, reverberation time and band limits. A null noise type reads as the
word "none", as it does in text; ``noise_given`` false says that there was none at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.prescriptions import BOUNDS, parse_prescription

COMPONENTS = ("format", "diagnosis", "parameter_bounds", "consistency", "overprocessing")
# fixed values of the rules
NOISES = ("white", "pink", "cafe", "hvac")
DEREVERB = ("dereverb", "wpe", "de_reverb")
RESTORE = ("bandwidth_extension", "equalizer", "eq")
SPACES = " \t\n\r\x0b\x0c"


def _no() -> Column:
    return F.array().cast("array<string>")


def _say(condition: Column, what: Column | str) -> Column:
    return F.when(condition, F.array(F.lit(what) if isinstance(what, str) else what)).otherwise(_no())


def _sum(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + of(x))


def _by_action(actions: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Violations of all actions, in order; ``of`` gets an action and the start of its messages."""
    return F.flatten(F.transform(actions, lambda a, i: of(a, F.concat(F.lit("action_"), i.cast("string"), F.lit("_")))))


def format_reward(p: Column) -> tuple[Column, Column]:
    n = F.size(p["missing"])
    steps = [
        (~p["valid"], F.lit(0.0), F.lit("invalid_json")),
        (n > 0, F.greatest(F.lit(0.0), 1 - 0.25 * n), F.concat(F.lit("missing_keys:"), F.array_join(p["missing"], ","))),
        (~p["diagnosis_object"], F.lit(0.5), F.lit("diagnosis_not_object")),
        (~p["actions_list"] | (F.size(p["actions"]) == 0), F.lit(0.5), F.lit("actions_empty_or_invalid")),
        (~p["rationale_ok"], F.lit(0.75), F.lit("rationale_empty")),
        (~p["confidence_ok"], F.lit(0.75), F.lit("confidence_out_of_range")),
    ]
    score, said = F.lit(1.0), _no()
    for condition, value, message in reversed(steps):
        score, said = F.when(condition, value).otherwise(score), F.when(condition, F.array(message)).otherwise(said)
    return score, said


def diagnosis_reward(p: Column, noise: Column, rt60: Column) -> tuple[Column, Column]:
    expected, got = F.lower(F.btrim(noise, F.lit(SPACES))), p["noise_type"]
    judged = p["valid"] & p["diagnosis_object"]
    near = F.contains(got, expected) | F.contains(expected, got)
    named = judged & (expected != "")
    match = F.when(got == expected, 1.0).when(near, 0.75).otherwise(0.0)
    reverb_off = F.coalesce(named & ((rt60 != 0) != p["reverb"]), F.lit(False))
    score = F.when(~judged, 0.0).when(expected == "", 0.5).otherwise(match * F.when(reverb_off, 0.75).otherwise(1.0))
    said = F.concat(
        _say(named & (got != expected) & ~near, F.concat(F.lit("noise_type_mismatch:"), got, F.lit("!="), expected)), _say(reverb_off, "reverb_mismatch")
    )
    return score, said


def bounds_reward(p: Column) -> tuple[Column, Column]:
    actions = p["actions"]

    def inside(a: Column, k: str) -> Column:
        return F.coalesce(a[k].between(*map(F.lit, BOUNDS[k])), F.lit(False))

    def ordered(a: Column) -> Column:
        return F.coalesce(a["low_hz"] < a["high_hz"], F.lit(False))

    def both(a: Column) -> Column:
        return a["has_low_hz"] & a["has_high_hz"]

    def one(condition: Column) -> Column:
        return condition.cast("double")

    def checks(a: Column) -> Column:
        return F.when(a["object"], sum((one(a[f"has_{k}"]) for k in BOUNDS), one(both(a)))).otherwise(1.0)

    def passed(a: Column) -> Column:
        return F.when(a["object"], sum((one(a[f"has_{k}"] & inside(a, k)) for k in BOUNDS), one(both(a) & ordered(a)))).otherwise(0.0)

    def say(a: Column, start: Column) -> Column:
        each = [_say(a[f"has_{k}"] & ~inside(a, k), F.concat(start, F.lit(f"{k}_out_of_range"))) for k in BOUNDS]
        order = _say(both(a) & ~ordered(a), F.concat(start, F.lit("frequency_order")))
        return F.when(a["object"], F.concat(*each, order)).otherwise(F.array(F.concat(start, F.lit("not_object"))))

    n = _sum(actions, checks)
    judged = p["valid"] & p["actions_list"]
    score = F.when(judged & (n > 0), _sum(actions, passed) / n).otherwise(0.0)
    return score, F.when(judged, F.concat(_by_action(actions, say), _say(n == 0, "no_executable_parameters"))).otherwise(_no())


def consistency_reward(p: Column, noise: Column, rt60: Column, bandlimit: Column) -> tuple[Column, Column]:
    objects = F.filter(p["actions"], lambda a: a["object"])
    kinds = F.transform(objects, lambda a: a["kind"])

    def lacks(names: tuple[str, ...]) -> Column:
        return ~F.arrays_overlap(kinds, F.array(*map(F.lit, names)))

    def blocks(a: Column) -> Column:
        return F.coalesce(a["object"] & a["highpass"] & (a["low_hz"] > 300), F.lit(False))

    untyped = F.lower(noise).isin(*NOISES) & (F.size(objects) == 0)
    no_dereverb = F.coalesce(rt60 != 0, F.lit(False)) & lacks(DEREVERB)
    no_restore = F.coalesce(F.size(bandlimit) > 0, F.lit(False)) & lacks(RESTORE)
    penalty = 0.5 * untyped.cast("double") + 0.25 * no_dereverb.cast("double") + 0.25 * no_restore.cast("double") + _sum(p["actions"], lambda a: 0.25 * blocks(a).cast("double"))
    judged = p["valid"] & p["actions_list"]
    said = F.concat(
        _say(untyped, "missing_action_type"),
        _say(no_dereverb, "reverb_without_dereverb_action"),
        _say(no_restore, "bandlimit_without_restoration_action"),
        _by_action(p["actions"], lambda a, start: _say(blocks(a), F.concat(start, F.lit("highpass_conflicts_with_speech")))),
    )
    return F.when(judged, F.greatest(F.lit(0.0), 1 - penalty)).otherwise(0.0), F.when(judged, said).otherwise(_no())


def overprocessing_reward(p: Column, snr: Column) -> tuple[Column, Column]:
    actions = p["actions"]

    def true(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    def cuts(a: Column) -> Column:
        return true(a["object"] & (a["reduction_db"] > 18))

    def loud(a: Column) -> Column:
        return true(a["object"] & (F.abs(a["gain_db"]) > 18))

    def high(a: Column) -> Column:
        return true(a["object"] & a["highpass"] & (a["low_hz"] > 180))

    def price(a: Column) -> Column:
        return F.when(cuts(a), F.least(F.lit(0.5), (a["reduction_db"] - 18) / 24)).otherwise(0.0) + 0.25 * loud(a).cast("double") + 0.25 * high(a).cast("double")

    total = _sum(actions, lambda a: F.when(true(a["object"]), F.greatest(F.lit(0.0), F.coalesce(a["reduction_db"], F.lit(0.0)))).otherwise(0.0))
    # Spark puts NaN above all numbers; here it is no high ratio
    clean = true((snr >= 20) & ~F.isnan(snr.cast("double")) & (total > 12))
    penalty = _sum(actions, price) + F.when(total > 30, F.least(F.lit(0.5), (total - 30) / 30)).otherwise(0.0) + 0.25 * clean.cast("double")

    def say(a: Column, start: Column) -> Column:
        return F.concat(
            _say(cuts(a), F.concat(start, F.lit("over_suppression"))),
            _say(loud(a), F.concat(start, F.lit("extreme_gain"))),
            _say(high(a), F.concat(start, F.lit("highpass_overprocessing"))),
        )

    judged = p["valid"] & p["actions_list"]
    said = F.concat(_by_action(actions, say), _say(total > 30, "cumulative_over_suppression"), _say(clean, "clean_signal_overprocessed"))
    return F.when(judged, F.greatest(F.lit(0.0), 1 - penalty)).otherwise(0.0), F.when(judged, said).otherwise(_no())


def weighted_total(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of the components, to six decimals; negative weights count as nought."""
    effective = dict.fromkeys(COMPONENTS, 1.0)
    if unknown := set(weights or {}) - set(effective):
        raise ValueError(f"unknown reward components: {sorted(unknown)}")
    effective = {k: max(0.0, v) for k, v in (effective | (weights or {})).items()}
    if sum(effective.values()) <= 0:
        raise ValueError("at least one reward weight must be positive")
    return F.bround(sum((components[k] * effective[k] for k in COMPONENTS), F.lit(0.0)) / sum(effective.values()), 6)


def score(
    rows: DataFrame,
    response_col: str = "response",
    noise: Column | None = None,
    snr: Column | None = None,
    rt60: Column | None = None,
    bandlimit: Column | None = None,
    noise_given: Column | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """``rows`` with valid_json, the five components, total and violations."""
    noise = F.coalesce(noise if noise is not None else F.col("noise_type"), F.lit("none"))
    if noise_given is not None:
        noise = F.when(noise_given, noise).otherwise("")
    snr, rt60 = snr if snr is not None else F.col("snr_db"), rt60 if rt60 is not None else F.col("reverb_rt60")
    bandlimit = bandlimit if bandlimit is not None else F.col("bandlimit_hz")
    parsed = rows.withColumn("__p", parse_prescription(response_col))
    p = F.col("__p")
    parts = {
        "format": format_reward(p),
        "diagnosis": diagnosis_reward(p, noise, rt60),
        "parameter_bounds": bounds_reward(p),
        "consistency": consistency_reward(p, noise, rt60, bandlimit),
        "overprocessing": overprocessing_reward(p, snr),
    }
    scored = parsed.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        p["valid"].alias("valid_json"),
        *[parts[k][0].alias(k) for k in COMPONENTS],
        F.array_distinct(F.concat(*[parts[k][1] for k in COMPONENTS])).alias("violations"),
    )
    return scored.withColumn("total", weighted_total({k: F.col(k) for k in COMPONENTS}, weights))


def ablation_totals() -> list[Column]:
    """For each component the total without it, from the scored columns; no answer is parsed again."""
    parts = {k: F.col(k) for k in COMPONENTS}
    return [weighted_total(parts, {k: 0.0}).alias(f"without_{k}") for k in COMPONENTS]


CONTEXT = "struct<noise_type:string,snr_db:double,reverb_rt60:double,bandlimit_hz:array<double>,noise_given:boolean>"


def score_batches(batches: DataFrame, completions_col: str = "completions", contexts_col: str = "contexts", key: str = "batch") -> DataFrame:
    """(key, rewards) for rows with an array of completions and their contexts, in order; ``key`` names a row.

    Contexts may be an array with one context for each completion (another number raises in the job), a single struct that all completions share, or
    null: then there is no context. In a context, or one that is null in the array, what is null is not given; a null noise type reads as the word
    "none" unless the field ``noise_given`` is false, and is not given at all where the whole context is null. A row without completions has no rewards.
    """
    texts, given = F.col(completions_col), F.col(contexts_col)
    if batches.schema[contexts_col].dataType.typeName() == "struct":
        spread = F.transform(texts, lambda _: given)
    else:
        wrong = F.raise_error(F.lit("contexts and completions must have the same length")).cast(batches.schema[contexts_col].dataType)
        spread = F.when(F.size(given) != F.size(texts), wrong).otherwise(given)
    pairs = F.transform(texts, lambda t, i: F.struct(t.alias("response"), F.get(spread, i).alias("context")))
    rows = batches.select(key, F.posexplode_outer(pairs).alias("at", "pair"))
    context = F.col("pair.context")
    fields = set(rows.select("pair.context.*").columns)

    def of(name: str, kind: str) -> Column:
        return context[name] if name in fields else F.lit(None).cast(kind)

    named = context.isNotNull() & F.coalesce(of("noise_given", "boolean"), F.lit(True))
    flat = rows.select(key, "at", F.col("pair.response").alias("response"), of("noise_type", "string").alias("noise"), of("snr_db", "double").alias("snr"), of("reverb_rt60", "double").alias("rt60"), of("bandlimit_hz", "array<double>").alias("band"), named.alias("named"))
    scored = score(flat, noise=F.col("noise"), snr=F.col("snr"), rt60=F.col("rt60"), bandlimit=F.col("band"), noise_given=F.col("named"))
    totals = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "total"))))
    return scored.groupBy(key).agg(F.transform(totals, lambda x: x["total"]).alias("rewards"))
