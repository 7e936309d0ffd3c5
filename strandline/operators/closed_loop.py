"""Plans that are executed, measured again, and accepted, revised or rolled back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import dsp, waveforms
from strandline.plans.runtime import cut

#: Weight of each metric, and its value between 0 and 1 (fixed values of the utility).
WEIGHTS = {"si_sdr": 0.25, "stoi": 0.20, "pesq": 0.15, "dnsmos": 0.15, "wer": 0.15, "speaker_similarity": 0.10}
MAX_ACTIONS = 8
PLAN = "array<struct<kind:string,value:double>>"


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _scaled(metrics: Column) -> dict[str, Column]:
    return {
        "si_sdr": 1 / (1 + F.exp(-metrics["si_sdr"] / 6)),
        "stoi": _unit(metrics["stoi"]),
        "pesq": _unit((metrics["pesq"] - 1) / 3.5),
        "dnsmos": _unit((metrics["dnsmos"] - 1) / 4),
        "wer": 1 - _unit(metrics["wer"]),
        "speaker_similarity": _unit(metrics["speaker_similarity"]),
    }


def utility(metrics: Column) -> Column:
    """The weighted mean of the metrics that there are; null if there is none."""
    given = {k: (F.when(metrics[k].isNotNull(), v), F.when(metrics[k].isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0)) for k, v in _scaled(metrics).items()}
    top = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in given.values()), F.lit(0.0))
    return top / F.nullif(sum((w for _, w in given.values()), F.lit(0.0)), F.lit(0.0))


def plan_violations(plan: Column) -> Column:
    """Faults of a plan, an array of (kind, value)."""
    unknown = F.exists(plan, lambda a: ~F.coalesce(a["kind"].isin(*dsp.ACTIONS), F.lit(False)))
    value_bad = F.exists(plan, lambda a: F.isnan(a["value"]) | (F.abs(a["value"]) == float("inf")))
    gain_bad = F.exists(plan, lambda a: (a["kind"] == "gain") & ~a["value"].between(0, 4))
    gate_bad = F.exists(plan, lambda a: (a["kind"] == "spectral_gate") & ~a["value"].between(0, 1))
    size = F.coalesce(F.size(plan), F.lit(0))
    checks = ((size < 1, "plan: empty"), (unknown, "action: unknown kind"), (size > MAX_ACTIONS, "plan: too long"), (value_bad, "action: not finite"), (gain_bad, "gain: outside [0, 4]"), (gate_bad, "gate: outside [0, 1]"))
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in checks]), lambda x: x.isNotNull())


def execute(y: Column, plan: list[tuple[str, float]]) -> Column:
    """The waveform after the actions of one plan, in order."""
    steps: dict[str, Callable[[Column, float], Column]] = {
        "gain": waveforms.gain,
        "dc_remove": lambda y, _: waveforms.remove_dc(y),
        "spectral_gate": dsp.spectral_gate,
    }
    if not 1 <= len(plan) <= MAX_ACTIONS:
        raise ValueError("a plan has one to eight actions")
    for kind, value in plan:
        y = steps[kind](y, value)
    return y


def decide(before: Column, attempts: Column, max_revisions: int, min_gain: float = 0.0) -> Column:
    """From the metrics before and of each attempt in order: what the loop does.

    Attempts after the first accepted one, or beyond ``max_revisions`` revisions, are not made. The struct
    has the decision, the number of attempts, the gain of the last one, and what each attempt led to. A
    gain that is no number is none. A metric set without any value raises an error, as there is nothing to compare.
    """
    base = F.coalesce(utility(before), F.raise_error(F.lit("no objective metric")).cast("double"))
    gains = F.transform(F.slice(attempts, 1, max_revisions + 1), lambda m: F.coalesce(utility(m), F.raise_error(F.lit("no objective metric")).cast("double")) - base)

    def good(x: Column) -> Column:
        return (x >= min_gain) & ~F.isnan(x)

    def of(g: Column) -> Column:
        hit = F.array_position(F.transform(g, lambda x: good(x).cast("int")), 1).cast("int")
        n = F.when(hit > 0, hit).otherwise(F.size(g))
        steps = F.transform(F.slice(g, 1, n), lambda x, i: F.when(good(x), "accept").when(i + 1 < n, "revise").otherwise("rollback"))
        return F.struct(F.when(hit > 0, "accept").otherwise("rollback").alias("decision"), n.alias("n_attempts"), F.get(g, n - 1).alias("utility_gain"), steps.alias("steps"))

    return F.element_at(F.transform(F.array(gains), of), 1)


def run_loop(rows: DataFrame, audio_col: str, plans: list[list[tuple[str, float]]], measure: Callable[[Column], Column], min_gain: float = 0.0) -> DataFrame:
    """``rows`` with the kept waveform and the decision of the loop.

    Every attempt starts from the source. ``plans`` holds the first plan and its revisions; ``measure`` gives
    the struct of metrics of a waveform column. Attempts are unrolled, as their number is bounded.
    """
    source = F.col(audio_col)
    tried = rows.withColumn("__tries", F.array(*[execute(source, p) for p in plans]))
    judged = tried.withColumn("__loop", decide(measure(source), F.transform("__tries", measure), len(plans) - 1, min_gain))
    last = F.element_at("__tries", F.col("__loop.n_attempts"))
    return judged.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.when(F.col("__loop.decision") == "accept", last).otherwise(source).alias("kept_audio"),
        last.alias("candidate_audio"),
        F.col("__loop").alias("loop"),
    )


def enhance(
    rows: DataFrame,
    audio_col: str,
    plan_col: str,
    measure: Callable[[Column], Column],
    reviser: Callable[[Column, Column, Column], Column] | None = None,
    max_revisions: int = 0,
    min_gain: float = 0.0,
    executor: Callable[[Column, Column], Column] = dsp.execute_plan,
) -> DataFrame:
    """``rows`` with kept_audio, candidate_audio, before, after, utility_gain, decision and attempts of the loop.

    Every row brings its own plan, an array of (kind, value). Round by round the plan of each open row is executed on the source
    and measured. A row is accepted at the first gain of ``min_gain`` or more; else ``reviser`` (plan, before, after) gives the next
    plan, and none (null), or ``max_revisions`` revisions, roll it back. Later rounds read open rows only, so attempts that are not made are not computed;
    each round is written once. A gain that is no number is none. A plan with faults, a null or empty waveform, or a measurement
    without any metric ends the job with an error.
    """
    if max_revisions < 0:
        raise ValueError("max_revisions cannot be negative")

    def sound(plan: Column) -> Column:
        faults = plan_violations(plan)
        return F.when(F.size(faults) > 0, F.raise_error(F.array_join(faults, "; ")).cast(PLAN)).otherwise(plan)

    audio = F.when(F.size(F.col(audio_col)) > 0, F.col(audio_col)).otherwise(F.raise_error(F.lit("audio must be a non-empty mono waveform")).cast(dsp.WAVE))
    going = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), audio.alias("audio"), F.col(plan_col).cast(PLAN).alias("plan"))
    going = going.withColumn("before", measure(F.col("audio")))
    done = None
    for at in range(max_revisions + 1):
        tried = going.withColumn("plan", sound(F.col("plan")))
        tried = tried.withColumn("candidate", executor(F.col("audio"), F.col("plan")))
        tried = tried.withColumn("after", measure(F.col("candidate")))
        scores = [F.coalesce(utility(F.col(c)), F.raise_error(F.lit("no objective metric")).cast("double")) for c in ("after", "before")]
        tried = tried.withColumn("gain", scores[0] - scores[1])
        revised = reviser(F.col("plan"), F.col("before"), F.col("after")) if reviser and at < max_revisions else F.lit(None)
        tried = tried.withColumn("next", revised.cast(PLAN))
        accepted = (F.col("gain") >= min_gain) & ~F.isnan("gain")
        tried = tried.withColumn("decision", F.when(accepted, "accept").when(F.col("next").isNull(), "rollback").otherwise("revise"))
        attempt = F.array(F.struct("plan", F.col("after").alias("metrics"), F.col("gain").alias("utility_gain"), "decision"))
        tried = cut(tried.withColumn("attempts", attempt if done is None else F.concat("attempts", attempt)), "attempts")
        ended = tried.filter("decision <> 'revise'")
        done = ended if done is None else done.unionByName(ended)
        going = tried.filter("decision = 'revise'").select("row", "audio", F.col("next").alias("plan"), "before", "attempts")
        if at == max_revisions or going.isEmpty():
            break
    kept = F.when(F.col("decision") == "accept", F.col("candidate")).otherwise(F.col("audio"))
    return done.select("row.*", kept.alias("kept_audio"), F.col("candidate").alias("candidate_audio"), "before", "after", F.col("gain").alias("utility_gain"), "decision", "attempts")
