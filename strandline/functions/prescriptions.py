"""Reading model answers: JSON text to one typed struct with presence flags.

This is the one Python step of scoring. Spark's JSON readers differ from the standard ones on NaN,
duplicate keys, trailing text, and booleans or strings where numbers are meant, so the text is decoded
in an Arrow-batched UDF, once, and all rules after it are built-in functions.
"""

from __future__ import annotations

import contextlib
import json
import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numeric parameters of an action, with the bounds in which they are safe (fixed values).
BOUNDS = {"reduction_db": (0.0, 24.0), "gain_db": (-24.0, 6.0), "q": (0.5, 20.0), "low_hz": (0.0, 20000.0), "high_hz": (20.0, 24000.0)}
REQUIRED = ("actions", "confidence", "diagnosis", "rationale")

_ACTION = "struct<object:boolean,kind:string,highpass:boolean," + ",".join(f"has_{k}:boolean,{k}:double" for k in BOUNDS) + ">"
PARSED = (
    "valid boolean, missing array<string>, diagnosis_object boolean, noise_type string, reverb boolean, "
    f"actions_list boolean, rationale_ok boolean, confidence_ok boolean, actions array<{_ACTION}>"
)


_ACTION_TYPE = pa.struct([("object", pa.bool_()), ("kind", pa.string()), ("highpass", pa.bool_()), *[f for k in BOUNDS for f in ((f"has_{k}", pa.bool_()), (k, pa.float64()))]])
_TYPES = {"missing": pa.list_(pa.string()), "noise_type": pa.string(), "actions": pa.list_(_ACTION_TYPE)}
_FIELDS = [pa.field(n, _TYPES.get(n, pa.bool_())) for n in (part.split(" ")[0] for part in PARSED.split(", "))]
FENCE = "```"


def finite(value: object) -> float | None:
    """A finite JSON number; booleans are none, and neither are whole numbers beyond the range of doubles."""
    if type(value) is int:
        value = float(value) if abs(value) <= sys.float_info.max else math.inf
    return value if type(value) is float and math.isfinite(value) else None


def unfenced(text: str) -> str:
    """A text without the code fence around it: its first line goes, and its last one if it is a fence only."""
    text = text.strip()
    if not text.startswith(FENCE):
        return text
    rows = text.splitlines()
    end = len(rows) - (rows[-1].strip() == FENCE)
    return "\n".join(rows[1:end])


def decode(text: str | None) -> dict | None:
    """The object in a text, which may stand in a code fence; None if there is no object."""
    with contextlib.suppress(ValueError, RecursionError):
        value = json.loads(unfenced(text or ""))
        return value if isinstance(value, dict) else None
    return None


def _action(a: object) -> dict:
    if not isinstance(a, dict):
        return {"object": False}
    out = {"object": True, "kind": str(a.get("type", "")).lower(), "highpass": a.get("type") == "highpass"}
    for k in BOUNDS:
        out[f"has_{k}"], out[k] = k in a, finite(a.get(k))
    return out


def describe(text: str | None) -> dict:
    """What the rules need to know of one answer."""
    p = decode(text)
    if p is None:
        return {"valid": False, "missing": [], "actions": []}
    d, actions, rationale, confidence = p.get("diagnosis"), p.get("actions"), p.get("rationale"), finite(p.get("confidence"))
    is_object, is_list = isinstance(d, dict), isinstance(actions, list)
    return {
        "valid": True,
        "missing": [k for k in REQUIRED if k not in p],
        "diagnosis_object": is_object,
        "noise_type": str(d.get("noise_type", "")).strip().lower() if is_object else "",
        "reverb": is_object and bool(d.get("reverb")),
        "actions_list": is_list,
        "rationale_ok": isinstance(rationale, str) and bool(rationale.strip()),
        "confidence_ok": confidence is not None and 0 <= confidence <= 1,
        "actions": [_action(a) for a in actions] if is_list else [],
    }


#: What a field is where an answer does not tell it.
UNTOLD = {"missing": [], "actions": [], "noise_type": ""}


def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Structs of PARSED, made by column; each distinct text of a batch is decoded once."""
    for texts in batches:
        coded = texts.dictionary_encode()
        rows = [describe(t) for t in coded.dictionary.to_pylist()]
        columns = [pa.array([r.get(f.name, UNTOLD.get(f.name, False)) for r in rows], f.type) for f in _FIELDS]
        yield pa.StructArray.from_arrays(columns, fields=list(_FIELDS)).take(coded.indices)


def parse_prescription(text: Column | str) -> Column:
    """A struct of what the rules need to know of an answer; null texts count as empty."""
    parse = F.arrow_udf(_parse, f"struct<{PARSED.replace(' ', ':').replace(',:', ', ')}>")
    return parse(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def completion_text(messages: Column) -> Column:
    """The text of a chat completion given as an array of (role, content)."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "")
