"""Completions of any shape as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.variants import at, kind


def _plain(value: Column) -> Column:
    """A value that is no list as text: a word for nothing and for truth, JSON for what is nested."""
    k = kind(value)
    words = F.when(k == "null", "None").when(k == "boolean", F.initcap(F.try_variant_get(value, "$", "string")))
    return words.when(k.isin("object", "array"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))


def _leaf(value: Column) -> Column:
    """The text of one message: its content if it is an object, nothing if there is none."""
    content = at(value, "$.content")
    return F.when(kind(value) == "object", F.when(kind(content) == "missing", F.lit("")).otherwise(_plain(content))).otherwise(_plain(value))


def normalized(rows: DataFrame, completion_col: str, out_col: str = "completion") -> DataFrame:
    """``rows`` with ``out_col``, the text of a VARIANT completion: texts and messages, in lists of any depth, put together in order.

    Lists are opened in place, one level a round, as long as any row still holds one; a round is one look at the rows and moves no data. Null stays
    null, an empty list gives an empty text. A message's own content is not opened: if it is no text, its JSON counts.
    """
    whole = F.col(f"`{completion_col}`")
    items = F.when(whole.isNotNull(), F.array(whole))

    def opened(x: Column) -> Column:
        return F.when(kind(x) == "array", x.cast("array<variant>")).otherwise(F.array(x))

    while not rows.filter(F.exists(items, lambda x: kind(x) == "array")).isEmpty():
        items = F.flatten(F.transform(items, opened))
    return rows.withColumn(out_col, F.array_join(F.transform(items, _leaf), ""))
