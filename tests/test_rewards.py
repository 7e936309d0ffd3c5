"""Native scoring against a plain scorer that was written for these tests."""

import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions.prescriptions import completion_text
from strandline.operators.rewards import COMPONENTS, ablation_totals, score, weighted_total

LIMITS = [("reduction_db", 0, 24), ("gain_db", -24, 6), ("q", 0.5, 20), ("low_hz", 0, 20000), ("high_hz", 20, 24000)]


def num(v):
    return float(v) if type(v) in (int, float) and math.isfinite(v) else None


def plain(text, noise, snr, rt60, band):
    """Components by rule, one after the other."""
    body = re.sub(r"\A```.*(?:\n|\Z)", "", re.sub(r"\n[ \t]*```\Z", "", text.strip().replace("\r\n", "\n").replace("\u2028", "\n")) if text.strip().startswith("```") else text.strip())
    try:
        p = json.loads(body)
    except ValueError:
        p = None
    if not isinstance(p, dict):
        return (0.0,) * 5
    lacking = sum(k not in p for k in ("diagnosis", "actions", "rationale", "confidence"))
    d, acts = p.get("diagnosis"), p.get("actions")
    c = num(p.get("confidence"))
    if lacking:
        fmt = max(0, 1 - lacking / 4)
    elif not isinstance(d, dict) or not isinstance(acts, list) or not acts:
        fmt = 0.5
    elif not isinstance(p["rationale"], str) or not p["rationale"].strip() or c is None or c < 0 or c > 1:
        fmt = 0.75
    else:
        fmt = 1.0
    diag = 0.0
    if isinstance(d, dict):
        want, got = str(noise).strip().lower(), str(d.get("noise_type", "")).strip().lower()
        if not want:
            diag = 0.5
        else:
            diag = 1.0 if got == want else 0.75 if want in got or got in want else 0.0
            if rt60 is not None and bool(rt60) != bool(d.get("reverb")):
                diag *= 0.75
    if not isinstance(acts, list):
        return fmt, diag, 0.0, 0.0, 0.0
    good = total = 0
    for a in acts:
        if not isinstance(a, dict):
            total += 1
            continue
        for k, lo, hi in LIMITS:
            if k in a:
                total += 1
                good += num(a[k]) is not None and lo <= num(a[k]) <= hi
        if "low_hz" in a and "high_hz" in a:
            total += 1
            good += None not in (num(a["low_hz"]), num(a["high_hz"])) and num(a["low_hz"]) < num(a["high_hz"])
    objects = [a for a in acts if isinstance(a, dict)]
    kinds = {str(a.get("type", "")).lower() for a in objects}
    cons = 1.0 - 0.5 * (str(noise).lower() in ("white", "pink", "cafe", "hvac") and not kinds)
    cons -= 0.25 * bool(rt60 and not kinds & {"dereverb", "wpe", "de_reverb"}) + 0.25 * bool(band and not kinds & {"bandwidth_extension", "equalizer", "eq"})
    over = cut = 0.0
    for a in objects:
        low, r, g = num(a.get("low_hz")), num(a.get("reduction_db", 0.0)), num(a.get("gain_db"))
        high = a.get("type") == "highpass" and low is not None
        cons -= 0.25 * (high and low > 300)
        over += 0.25 * (high and low > 180) + 0.25 * (g is not None and abs(g) > 18)
        if r is not None:
            cut += max(0, r)
            over += min(0.5, (r - 18) / 24) if r > 18 else 0
    over += (min(0.5, (cut - 30) / 30) if cut > 30 else 0) + 0.25 * (snr is not None and snr >= 20 and cut > 12)
    return fmt, diag, good / total if total else 0.0, max(0.0, cons), max(0.0, 1 - over)


def cases():
    values = [0, 5, 19, 36, -30, 301, 200.5, None, True, "7600", [10], {}, float("inf"), float("nan")]
    rng = random.Random(4)
    whole = {"diagnosis": {"noise_type": "white", "reverb": True}, "actions": [{"type": "highpass", "low_hz": 200}], "rationale": "r", "confidence": 0.5}
    texts = ["not-json", "", "[1]", "{}", '{"a":1} x', "{'a':1}", '{"actions": [], "actions": [{"q": 1}]}', json.dumps(whole), "```json\n" + json.dumps(whole) + "\n```", "  " + json.dumps(whole)]
    for key, v in itertools.product(("diagnosis", "actions", "rationale", "confidence"), values):
        texts.append(json.dumps(whole | {key: v}))
    for _ in range(250):
        acts = [{k: rng.choice(values) for k in rng.sample(["reduction_db", "gain_db", "q", "low_hz", "high_hz", "type"], rng.randint(0, 6))} for _ in range(rng.randint(0, 3))]
        for a in acts:
            if rng.random() < 0.7:
                a["type"] = rng.choice(["highpass", "Highpass", "dereverb", "EQ", "notch"])
        texts.append(json.dumps(whole | {"actions": acts + rng.choice([[], ["x"], [None]]), "diagnosis": {"noise_type": rng.choice(["", "pink", "white noise", None]), "reverb": rng.choice(values)}}))
    for t in texts:
        yield t, rng.choice(["white", " Pink ", "", "unknown", "cafe"]), rng.choice([None, 10.0, 25.0]), rng.choice([None, 0.0, 0.4]), rng.choice([None, [], [300.0, 3400.0]])


def test_against_plain_scorer(spark):
    rows = list(cases())
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, response string, noise_type string, snr_db double, reverb_rt60 double, bandlimit_hz array<double>")
    for r in score(frame).collect():
        want = plain(*rows[r["i"]])
        assert [r[c] for c in COMPONENTS] == pytest.approx(want), rows[r["i"]]
        assert r["total"] == pytest.approx(round(sum(want) / 5, 6), abs=2e-6)
        assert 0 <= r["total"] <= 1 and len(set(r["violations"])) == len(r["violations"])


def one(spark, text, **context):
    row = {"response": text, "noise_type": "white", "snr_db": 10.0, "reverb_rt60": None, "bandlimit_hz": None} | context
    return score(spark.createDataFrame([tuple(row.values())], "response string, noise_type string, snr_db double, reverb_rt60 double, bandlimit_hz array<double>")).first()


GOOD = {"diagnosis": {"noise_type": "white", "reverb": False}, "actions": [{"type": "spectral_subtraction", "reduction_db": 8, "low_hz": 80, "high_hz": 7600}], "rationale": "ok", "confidence": 0.8}


def test_good_and_bad_answers(spark):
    r = one(spark, json.dumps(GOOD))
    assert r["total"] == 1.0 and r["violations"] == []
    bad = json.loads(json.dumps(GOOD))
    bad["actions"][0]["reduction_db"] = 36
    assert one(spark, json.dumps(bad), snr_db=22.0)["total"] < 0.8
    r = one(spark, "not-json")
    assert r["format"] == 0 and r["parameter_bounds"] == 0 and not r["valid_json"] and r["violations"] == ["invalid_json"]
    bad["actions"][0]["reduction_db"] = float("inf")
    assert "action_0_reduction_db_out_of_range" in one(spark, json.dumps(bad))["violations"]
    assert one(spark, None)["total"] == 0


def test_missing_noise_and_weights(spark):
    frame = spark.createDataFrame([(json.dumps(GOOD), None, None, None, None)], "response string, noise_type string, snr_db double, reverb_rt60 double, bandlimit_hz array<double>")
    assert score(frame, noise_given=F.lit(False)).first()["diagnosis"] == 0.5
    assert score(frame).first()["diagnosis"] == 0.0  # the word none
    assert score(frame, weights={"diagnosis": 0}).first()["total"] == 1.0
    with pytest.raises(ValueError):
        weighted_total({}, {"invented": 1})
    with pytest.raises(ValueError):
        weighted_total({}, dict.fromkeys(COMPONENTS, 0))
    assert len(score(frame).select(*ablation_totals()).first()) == 5


def test_chat_completion(spark):
    frame = spark.createDataFrame([([("assistant", '{"a"'), ("assistant", ": 1}")],)], "m array<struct<role:string,content:string>>")
    assert frame.select(completion_text(F.col("m"))).first()[0] == '{"a": 1}'
