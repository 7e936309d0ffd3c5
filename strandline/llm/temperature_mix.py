"""Temperature mixing of sources under a token budget.

Source shares p of all tokens become weights proportional to p ** alpha. Alpha is bisected in [0, 1]: the
largest one whose weights reach the entropy asked for, then raised, if need be, until no source is
repeated more often than allowed. Each source gets the whole tokens in budget * weight; where that is a whole
number of tokens or of passes but for the rounding of doubles, it is that number. So at alpha 1 and the
whole budget every document is taken.

They are drawn as block permutations. The documents of a source are dealt into blocks by hash; every pass
over a source permutes its blocks, and the documents in each, anew, and a document is taken if it ends
within the source's tokens. Whole passes so repeat a source, and the last pass is cut by the budget.
Positions come from sums by block and running sums within blocks, so no task orders a whole source.

Texts take no part in this: a table of source, id, hash of the text, size and count is all that is ordered, and
rows are joined with what it says of them once, at the end, where they are repeated too.

Tokens are words. Null and empty texts have none; they are taken once, with the first pass. A null
source is a source. Rows with the same id, source and size are alike, and ties between them are of no
consequence; those with the same text too are numbered by the task that joins them, to take one place each. All columns of the input stay; the columns ``mix_pass`` and ``mix_start`` are added, in place of
columns of these names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.host_rules import words_of
from strandline.plans.runtime import cut, join_small

STEPS, DEPTH = 40, 5
#: The relative error that doubles may put on a source's share of the budget.
NEAR = 1e-12


def _hash(*parts: Column | str) -> Column:
    """A 60-bit hash that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _measures(totals: DataFrame, budget: float) -> Callable[[list[float]], list[tuple[float, float]]]:
    """Exponents -> for each the entropy of the weights and the largest number of repeats, in one aggregation over the sources."""
    positive = totals.filter("total > 0").select("total")
    whole = positive.agg(F.sum("total")).first()[0]

    def of(alphas: list[float]) -> list[tuple[float, float]]:
        each = positive.select("total", F.posexplode(F.array(*[F.lit(float(a)) for a in alphas])).alias("i", "alpha"))
        raised = each.select("i", "total", F.pow(F.col("total") / whole, F.col("alpha")).alias("w"))
        sums = raised.groupBy("i").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("total")).alias("most"))
        return [(math.log(r["w"]) - r["wl"] / r["w"], r["most"] / r["w"] * budget) for r in sums.orderBy("i").collect()]

    return of


def find_alpha(measures: Callable[[list[float]], list[tuple[float, float]]], entropy: float | None, max_repeats: float | None) -> float:
    """The exponent, to six decimals. Entropy falls with it, and so do the repeats of small sources.

    An interval is bisected ``DEPTH`` times by one call, which measures all the points that bisection could ask for.
    """

    def bisect(ok: Callable[[tuple[float, float]], bool], low_ok: bool) -> float:
        lo, hi = 0.0, 1.0
        if ok(measures([hi if low_ok else lo])[0]):
            return hi if low_ok else lo
        for _ in range(STEPS // DEPTH):
            n = 1 << DEPTH
            points = [lo + (hi - lo) * i / n for i in range(n + 1)]
            good = [low_ok, *[ok(m) for m in measures(points[1:-1])], not low_ok]
            a, b = 0, n
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if good[mid] == low_ok else (a, mid)
            lo, hi = points[a], points[b]
        return lo if low_ok else hi

    alpha = 1.0 if entropy is None else bisect(lambda m: m[0] >= entropy, True)
    if max_repeats is not None and measures([alpha])[0][1] > max_repeats:
        alpha = max(alpha, bisect(lambda m: m[1] <= max_repeats, False))
    return round(alpha, 6)


def _quota(due: Column, total: Column) -> Column:
    """Whole tokens of ``due``, which is not exact."""
    passes, tokens = F.round(due / F.greatest(total, F.lit(1))) * total, F.round(due)
    return F.when(F.abs(due - passes) <= due * NEAR, passes).when(F.abs(due - tokens) <= due * NEAR, tokens).otherwise(F.floor(due)).cast("long")


def temperature_mix(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    entropy_share: float | None = 0.99,
    max_repeats: float | None = 3.0,
    budget_share: float = 1.0,
    block_tokens: int = 1 << 20,
    seed: int = 17,
) -> DataFrame:
    """The rows of ``docs`` drawn for the mixture, one row for each time a document is taken.

    ``entropy_share`` is the entropy asked for as a share of that of equal weights; None keeps the
    natural shares. ``budget_share`` is the token budget as a share of all tokens. The number of tokens
    in a block grows with the square root of all tokens from ``block_tokens`` on.
    """
    tokens, key = F.size(words_of(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).cast("long"), F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    same = ["__key", "__id", "__text"]
    text = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # the row is one column, so that no name of the input can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    named = docs.select(row, key.alias("__key"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("__id"), text.alias("__text"), tokens.alias("__tokens"))
    sizes = cut(named.groupBy(*same).agg(F.max("__tokens").alias("__tokens"), F.count("*").alias("__n")), "sizes")
    sized = sizes.withColumn("__all", F.col("__tokens") * F.col("__n"))
    totals = cut(sized.groupBy(F.col("__key").alias("key")).agg(F.sum("__all").alias("total")), "totals")
    whole, n_sources = totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count_if(F.col("total") > 0)).first()
    budget = whole * budget_share
    alpha = 1.0
    if n_sources > 1:
        alpha = find_alpha(_measures(totals, budget), entropy_share and entropy_share * math.log(n_sources), max_repeats)
    raised = F.pow(F.col("total") / max(whole, 1), F.lit(alpha))
    norm = totals.filter("total > 0").agg(F.sum(raised)).first()[0] or 1.0
    # at alpha 1 the weights are the shares, and no division is needed
    due = F.when(F.col("total") > 0, F.col("total") * F.lit(float(budget_share)) if alpha == 1 else raised / norm * budget).otherwise(0.0)
    size = max(block_tokens, math.isqrt(int(whole)))
    plans = totals.select(
        F.col("key").alias("__key"),
        F.col("total").alias("__total"),
        _quota(due, F.col("total")).alias("__quota"),
        F.greatest(F.ceil(F.col("total") / size), F.lit(1)).alias("__n_blocks"),
    ).withColumn("__passes", F.greatest(F.ceil(F.col("__quota") / F.greatest("__total", F.lit(1))), F.lit(1)).cast("int"))

    block = F.pmod(_hash(F.lit(f"{seed}:b"), "__key", "__id"), F.col("__n_blocks"))
    dealt = join_small(sized, plans, ["__key"]).withColumn("__block", block)
    sums = dealt.groupBy("__key", "__block").agg(F.sum("__all").alias("n"), F.first("__passes").alias("passes"), F.first("__total").alias("total"))
    in_pass = sums.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    order = Window.partitionBy("__key", "pass").orderBy(_hash(F.lit(f"{seed}:o"), "pass", "__key", "__block"), "__block")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = in_pass.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("pass") * F.col("total"))
    starts = starts.groupBy("__key", "__block").agg(F.collect_list(F.struct("pass", "start")).alias("__starts"))

    placed = dealt.join(starts, ["__key", "__block"]).withColumn("__at", F.explode("__starts"))
    inner = Window.partitionBy("__key", "__block", F.col("__at.pass")).orderBy(_hash(F.lit(f"{seed}:d"), F.col("__at.pass"), "__key", "__id"), "__id", "__tokens", "__text")
    first = F.col("__at.start") + F.coalesce(F.sum("__all").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # how many of the rows that are the same end within the quota
    fit = F.when(F.col("__tokens") > 0, F.least("__n", F.expr("(__quota - __first) div __tokens"))).when(F.col("__first") <= F.col("__quota"), F.col("__n"))
    drawn = placed.withColumn("__first", first).withColumn("__fit", fit).filter("__fit > 0")
    drawn = drawn.select(*same, "__tokens", "__fit", "__first", F.col("__at.pass").alias("__pass"))

    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    taken = named.select("__row", *same).withColumn("__nth", nth).join(drawn, same).filter("__nth <= __fit")
    keep = [F.col(f"__row.`{c}`") for c in docs.columns if c not in ("mix_pass", "mix_start")]
    return taken.select(*keep, F.col("__pass").alias("mix_pass"), (F.col("__first") + (F.col("__nth") - 1) * F.col("__tokens")).alias("mix_start"))
