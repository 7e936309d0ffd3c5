"""Quality rules with verdicts on hosts, in DataFrame functions only.

Each document is measured by fixed rules. Failures are counted by host; a host's failure rate is shrunk
towards the mean of all hosts with a beta prior whose two parameters are fitted to the hosts by moments,
so that a host with few documents is not judged on chance. Documents of a host whose shrunk rate
exceeds ``max_rate`` are rejected with it, and those that fail the base rules in any case.

A null text has no words, and so fails. A null host is a host of its own. Repeated rows count and are
returned as often as they stand. Other columns are not read. An empty table gives an empty result.
Hosts are counted with map-side combination; a host with a third of all rows is one row of that table,
which is broadcast if it is small by count and dealt over salts otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.runtime import cut, join_small

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _covered(windows: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""

    def from_sorted(s: Column) -> Column:
        again = F.transform(
            s,
            lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"]),
        )
        return let(F.sort_array(F.filter(again, lambda p: p.isNotNull())), count)

    def count(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(F.sort_array(numbered), from_sorted))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words which occurs twice or more in the text."""

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, _covered))

    return let(words, of)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the base counts of each row."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = rows.select(
        "doc_id",
        "host",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again"))).alias("words"),
        F.length(F.regexp_replace("text", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    return counted.select(
        "doc_id", "host", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("words.again").alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_failed() -> Column:
    """What also counts against a host: many symbols or repeated lines."""
    return (10 * F.col("n_symbols") > 3 * F.col("n_words")) | (10 * F.col("n_dup_lines") > F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the beta prior by the moments of the hosts' rates (``n`` rows, ``k`` failures)."""
    mean_rate = hosts.agg((F.sum("k") / F.sum("n")).alias("m")).first()["m"]
    if mean_rate is None or not 0 < mean_rate < 1:
        rate = mean_rate or 0.0
        return rate + 0.5, 1.5 - rate
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean_rate, F.lit(2.0))) / F.sum("n")
    row = hosts.agg(spread.alias("s"), F.count("*").alias("h"), F.sum("n").alias("n")).first()
    chance = mean_rate * (1 - mean_rate)
    between = max(row["s"] - chance * row["h"] / row["n"], chance / 1000)
    strength = max(chance / between - 1, 1.0)
    return mean_rate * strength, (1 - mean_rate) * strength


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def _rates(stats: DataFrame) -> DataFrame:
    """(host_key, shrunk failure rate) from the marks of measured rows."""
    failed = F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("k")
    hosts = cut(stats.groupBy("host_key").agg(F.count("*").alias("n"), failed), "hosts")
    a, b = beta_prior(hosts)
    return hosts.select("host_key", ((F.col("k") + a) / (F.col("n") + a + b)).alias("rate"))


def passing(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns: the verdicts of ``host_verdicts`` taken as a filter.

    Only counts by host are written; rows are measured once for them and again when they are returned, as their texts would take as
    much disk as the input until its owner clears it. A row is held in one column, so that no name of the input can clash.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(row.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").alias("source"))
    stats = measure(held).select(F.col("doc_id").alias("row"), _host_key(F.col("host")).alias("host_key"), base_failed().alias("base_failed"), soft_failed().alias("soft_failed"))
    good = cut(_rates(stats.drop("row")).filter(F.col("rate") <= max_rate).select("host_key"), "hosts")
    # no filter, which would measure a row for every mention of a measure
    passed = stats.select(F.inline(F.when(~F.col("base_failed"), F.array(F.struct("row", "host_key")))))
    return join_small(passed, good, ["host_key"], "left_semi").select("row.*")


def host_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.6
) -> DataFrame:
    """Counts, base_failed, the shrunk rate of the host and kept, for every row of ``docs``."""
    marks = {"base_failed": base_failed(), "soft_failed": soft_failed(), "host_key": _host_key(F.col("host"))}
    stats = cut(measure(docs, id_col, text_col, host_col).withColumns(marks), "quality")
    joined = join_small(stats, _rates(stats), ["host_key"])
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("rate") <= max_rate)).alias("kept"),
        F.round("rate", 6).alias("host_rate"),
    )
