"""JSON texts in one form: keys sorted at every level, a space after each comma and colon, shortest numbers, no escapes beyond ASCII."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _canonical(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True) for t in texts], dtype=object)


def canonical_json(text: Column) -> Column:
    """The canonical form of a JSON text, byte for byte what the usual encoder writes; null stays null, other texts end the job.

    Of repeated keys the last one counts. Built-in functions can neither sort the keys of nested objects nor write numbers in that form.
    """
    return F.pandas_udf(_canonical, "string")(text)


def _public(texts: pd.Series) -> pd.Series:
    shown = ({k: v for k, v in json.loads(t).items() if not k.startswith("_")} if t is not None else None for t in texts)
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for v in shown], dtype=object)


def public_digest(text: Column) -> Column:
    """sha256 of the canonical form of a JSON object without its keys that start with an underscore."""
    return F.sha2(F.pandas_udf(_public, "string")(text), 256)
