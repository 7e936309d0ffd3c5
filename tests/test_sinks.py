import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from test_lines import value

from strandline.functions.canonical import canonical_json
from strandline.sources import records


def test_canonical_texts_equal_the_plain_encoder(spark):
    rng = random.Random(5)
    values = [value(rng) for _ in range(300)] + [{"b": 1e300, "a": [0.1, 1e-7, 1e16, -0.0, 5.0, 2**70], "é": {"z": None, "A": "\u2028\t\x00"}}]
    frame = spark.createDataFrame([(json.dumps(v, indent=rng.choice([None, 1])),) for v in values] + [(None,)], "t string")
    want = [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in values]
    assert [r[0] for r in frame.select(canonical_json(F.col("t"))).collect()] == [*want, None]


def bundle(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, split string, acoustics struct<snr_db:double,noise:string>")


ROWS = [("a", "train", (5.0, "é")), ("b", "train", (None, None)), ("c", "eval", (0.1, "x"))]


def test_manifest_tells_of_the_bytes(spark, tmp_path):
    records.write_bundle({"sft": bundle(spark, ROWS), "dpo": bundle(spark, ROWS[:1])}, str(tmp_path), {"seed": 42}, 1)
    manifest = json.loads((tmp_path / "dataset_manifest.json").read_text())
    assert manifest["seed"] == 42 and manifest["counts"] == {"sft": {"train": 2, "eval": 1, "test": 0}, "dpo": {"train": 1, "eval": 0, "test": 0}}
    assert len(manifest["files"]) == 4 and sum(f["rows"] for f in manifest["files"].values()) == 4
    for name, of in manifest["files"].items():
        data = (tmp_path / name).read_bytes()
        assert of == {"bytes": len(data), "rows": data.count(b"\n"), "sha256": hashlib.sha256(data).hexdigest()}
    lines = sorted(line for p in tmp_path.glob("sft/split=*/part-*") for line in p.read_text().splitlines())
    assert lines[0] == '{"acoustics": {"noise": "x", "snr_db": 0.1}, "sample_id": "c"}' or '"split"' in lines[0]
    assert not list(tmp_path.glob("*.part"))


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    records.write_bundle({"sft": bundle(spark, ROWS)}, str(tmp_path))
    bad = bundle(spark, ROWS).withColumn("sample_id", F.when(F.col("sample_id") == "b", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("sample_id")))
    with pytest.raises(Exception, match="lost"):
        records.write_bundle({"sft": bundle(spark, ROWS), "dpo": bad}, str(tmp_path))
    assert not (tmp_path / "dataset_manifest.json").exists()


def test_publish_replaces_in_one_step(spark, tmp_path):
    for n in (1, 2):
        records.publish_json(spark, f"file://{tmp_path}/m.json", {"n": n, "a": "é"})
    assert (tmp_path / "m.json").read_text() == '{\n  "a": "é",\n  "n": 2\n}\n' and len(list(tmp_path.glob("m.json*"))) == 1


def test_errors_say_file_and_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{oops\n')
    with pytest.raises(Exception, match=r"x.jsonl:3: invalid JSON"):
        records.read_jsonl(spark, str(tmp_path)).collect()


def test_native_manifest(spark, tmp_path):
    rows = [("a", "a.wav", "t"), ("a", "/b.wav", "t"), ("", "c.wav", ""), ("d", None, "t")]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(dict(zip(("sample_id", "audio_path", "target_text"), r, strict=True))) for r in rows))
    listing = spark.createDataFrame([("/base/a.wav",), ("/base/c.wav",)], "path string")
    got = {r["line"]: (r["audio_path"], r["violations"]) for r in records.read_native_manifest(spark, str(tmp_path), "/base", listing).collect()}
    assert got == {
        1: ("/base/a.wav", []),
        2: ("/b.wav", ["sample_id: duplicate", "audio_path: no file"]),
        3: ("/base/c.wav", ["sample_id: missing", "target_text: missing"]),
        4: (None, ["audio_path: missing", "audio_path: no file"]),
    }
    (tmp_path / "none").mkdir()
    (tmp_path / "none/m.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="empty"):
        records.read_native_manifest(spark, str(tmp_path / "none"), "/base")
