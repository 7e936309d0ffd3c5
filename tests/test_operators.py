import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import dsp, waveforms
from strandline.operators import closed_loop, contracts, degradation, derive, evaluate, rewards, runs
from strandline.operators.split import deterministic_split, kth_hash
from strandline.sources import audio, records

GOOD = {
    "schema_version": contracts.AUDIO_SCHEMA, "sample_id": "a", "split": "train", "audio": {"noisy_path": "x.wav", "sample_rate": 16000, "duration_seconds": 3.0},
    "acoustics": {"noise_type": "white", "snr_db": 8}, "target": {"diagnosis": {}, "actions": [{"type": "x"}], "rationale": ""},
}


def faults(spark, *rows):
    frame = spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(rows)], "i int, line string")
    return [r[1] for r in frame.select("i", contracts.audio_violations(F.parse_json("line"))).orderBy("i").collect()]


def test_audio_contract(spark):
    def changed(path, value):
        out = json.loads(json.dumps(GOOD))
        *head, last = path.split(".")
        at = out
        for h in head:
            at = at[h]
        if value is ...:
            del at[last]
        else:
            at[last] = value
        return out

    edits = [
        ("audio.sample_rate", 100, "audio.sample_rate: outside [8000, 192000]"), ("audio.sample_rate", 16000.5, "audio.sample_rate: not integer"), ("audio.sample_rate", "1", "audio.sample_rate: not integer"),
        ("split", None, "split: unknown"), ("split", "dev", "split: unknown"), ("acoustics.snr_db", 81, "acoustics.snr_db: outside [-30, 80]"), ("target.actions", [], "target.actions: empty"),
        ("acoustics.noise_type", " \n", "acoustics.noise_type: empty"), ("audio.duration_seconds", 0, "audio.duration_seconds: not positive"), ("audio.duration_seconds", "3", "audio.duration_seconds: not positive"),
        ("schema_version", "v1", "schema_version"), ("audio", ..., "audio: missing"), ("audio.noisy_path", ..., "audio.noisy_path: missing"), ("target.diagnosis", [], "target.diagnosis: not object"), ("sample_id", 5, "sample_id: not string"),
    ]
    got = faults(spark, GOOD, changed("split", ...), changed("acoustics.snr_db", None), "[1]", *[changed(p, v) for p, v, _ in edits])
    assert got[:4] == [[], [], [], ["record: not object"]]
    for (_, _, want), have in zip(edits, got[4:], strict=True):
        assert want in have


def test_messages_strict_and_duplicates(spark):
    kind = "messages array<struct<role:string,content:string>>"
    rows = [([("user", "a"), ("assistant", "b")],), ([("user", " ")],), ([],), ([("bot", "x"), ("assistant", "y")],), (None,)]
    frame = spark.createDataFrame(rows, kind).withColumn("violations", contracts.message_violations(F.col("messages"), True))
    got = [r["violations"] for r in frame.collect()]
    assert got[0] == [] and "message: empty content" in got[1] and "messages: empty" in got[2] and got[3] == ["message: invalid role"] and "messages: empty" in got[4]
    with pytest.raises(Exception, match="empty|no assistant|invalid role"):
        contracts.strict(frame).collect()
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "sample_id string")
    assert contracts.duplicate_ids(ids).collect()[0].asDict() == {"sample_id": "a", "n": 2}


@pytest.mark.parametrize("ratio", [0.0, 0.05, 0.25, 0.9])
def test_split(spark, ratio):
    rows = [(f"s{i}", ["train", "eval", "test", "unassigned", None][i % 5 if i % 3 else 3]) for i in range(60)]
    got = {r[0]: r[1] for r in deterministic_split(spark.createDataFrame(rows, "sample_id string, split string"), 7, ratio).collect()}
    open_ids = sorted((i for i, s in rows if s not in ("train", "eval", "test")), key=lambda i: hashlib.sha256(f"7:{i}".encode()).digest())
    k = min(len(open_ids), max(0, (max(1, round(60 * ratio)) if ratio else 0) - sum(s == "eval" for _, s in rows)))
    for n, i in enumerate(open_ids):
        assert got[i] == ("eval" if n < k else "train")
    assert all(got[i] == s for i, s in rows if s in ("train", "eval", "test"))


def test_corruption_and_legacy(spark):
    action = "struct<gain_db:double,high_hz:double,low_hz:double,q:double,reduction_db:double,type:string>"
    rows = [(0, [(None, None, None, None, 5.0, "a"), (None, None, None, None, 6.0, "b")]), (1, [(2.0, None, None, None, None, "g")]), (2, [(None, None, None, 4.0, None, "n")]), (3, [])]
    got = [r[1] for r in spark.createDataFrame(rows, f"i int, actions array<{action}>").select("i", derive.corrupt_actions(F.col("actions"))).orderBy("i").collect()]
    assert got[0][0]["reduction_db"] == 36 and got[0][1]["reduction_db"] == 6
    assert got[1][0]["gain_db"] == -30 and got[1][0]["reduction_db"] is None
    assert got[2][0]["reduction_db"] == 36 and got[2][0]["q"] == 4
    assert got[3][0]["type"] == "spectral_subtraction" and len(got[3]) == 1


def test_evaluation(spark):
    ds = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    preds = spark.createDataFrame([("a", "x"), ("z", "y")], "sample_id string, response string")
    assert [r[0] for r in evaluate.unknown_ids(ds, preds).collect()] == ["z"]
    assert evaluate.coverage(ds, preds).first()["prediction_coverage"] == 0.5
    assert evaluate.with_predictions(ds, preds).count() == 1
    gate = spark.createDataFrame([(s, 200) for s in ("base", "sft", "dpo", "grpo")], "stage string, num_samples long")
    assert evaluate.release_gate(gate, 200).first()["accepted"]
    assert not evaluate.release_gate(gate.filter("stage <> 'dpo'"), 200).first()["accepted"]
    assert not evaluate.release_gate(gate, 100).first()["accepted"]


def test_waveforms(spark):
    y = np.sin(np.arange(1200) / 5).astype(np.float32)
    frame = spark.createDataFrame([(1, y.tolist()), (2, []), (3, None)], "i int, y array<float>")
    c = F.col("y")
    out = frame.select("i", waveforms.rms(c).alias("rms"), F.size(waveforms.frame_energies(c)).alias("n"), waveforms.pooled(c, 500).alias("p"), waveforms.gain(c, 2.0).alias("g"), waveforms.sign_changes(c).alias("z")).orderBy("i").collect()
    assert out[0]["rms"] == pytest.approx(float(np.sqrt((y.astype(float) ** 2).mean())))
    assert out[0]["n"] == 2  # a last frame that ends at the end is dropped
    assert out[0]["p"] == pytest.approx([float(y[a : a + 500].mean()) for a in (0, 500, 1000)], abs=1e-6)
    assert max(out[0]["g"]) == 1 and min(out[0]["g"]) == -1
    assert out[0]["z"] == int((np.signbit(y[1:]) != np.signbit(y[:-1])).sum())
    assert out[1]["rms"] is None and out[2]["rms"] is None and out[1]["p"] == []


def test_spectral_kernels(spark):
    t = np.arange(4000) / 16000
    y = (np.sin(2 * np.pi * 100 * t) + np.sin(2 * np.pi * 1000 * t)).astype(np.float32)
    frame = spark.createDataFrame([(1, y.tolist()), (2, None)], "i int, y array<float>")
    got = frame.select(dsp.band_limit(F.col("y"), 300, 3400).alias("b"), dsp.spectral_gate(F.col("y"), 0.99).alias("g"), dsp.spectral_subtraction(F.col("y")).alias("s"), dsp.reverb(F.col("y"), 0.05).alias("r")).collect()
    b = np.fft.rfft(np.array(got[0]["b"]))
    assert abs(b[25]) < 0.1 * abs(b[250]) and abs(b[250]) == pytest.approx(2000, rel=0.1)
    assert len(got[0]["g"]) == len(got[0]["r"]) == 4000 and max(map(abs, got[0]["s"])) == pytest.approx(0.95, abs=1e-5)
    assert got[1]["b"] is None
    kinds = spark.range(1).select(*[dsp.noise(F.lit(3), F.lit(2000), k).alias(k) for k in degradation.NOISES]).first()
    assert all(len(kinds[k]) == 2000 for k in degradation.NOISES) and max(map(abs, kinds["pink"])) == pytest.approx(1)


def test_closed_loop(spark):
    m = "struct<si_sdr:double,stoi:double,pesq:double,dnsmos:double,wer:double,speaker_similarity:double>"
    rows = [((2.0, 0.6, None, None, None, None), [(1.0, 0.55, None, None, None, None), (5.0, 0.75, None, None, None, None)])]
    frame = spark.createDataFrame(rows, f"before {m}, tries array<{m}>")
    loop = frame.select(closed_loop.decide(F.col("before"), F.col("tries"), 1).alias("x")).first()["x"]
    assert loop["decision"] == "accept" and loop["steps"] == ["revise", "accept"]
    loop = frame.select(closed_loop.decide(F.col("before"), F.col("tries"), 0).alias("x")).first()["x"]
    assert loop["decision"] == "rollback" and loop["steps"] == ["rollback"]
    audio_rows = spark.createDataFrame([([-0.8, 0.25, 0.8],)], "y array<float>")

    def loud(y):
        none = F.lit(None).cast("double")
        return F.struct(none.alias("si_sdr"), waveforms.peak(y).alias("stoi"), none.alias("pesq"), none.alias("dnsmos"), none.alias("wer"), none.alias("speaker_similarity"))

    out = closed_loop.run_loop(audio_rows, "y", [[("gain", 0.5)], [("gain", 2.0)]], loud, 0.01).first()
    assert out["kept_audio"] == [-1.0, 0.5, 1.0] and out["loop"]["n_attempts"] == 2
    plans = spark.createDataFrame([([("gain", 5.0)],), ([],), ([("spectral_gate", 0.5)],)], "p array<struct<kind:string,value:double>>")
    assert [r[0] for r in plans.select(closed_loop.plan_violations(F.col("p"))).collect()] == [["gain: outside [0, 4]"], ["plan: empty"], []]


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sample_id": "b", "response": "x"}\n\n  \n{"sample_id": "a", "response": "y"}\n')
    got = records.read_predictions(spark, str(tmp_path / "a.jsonl")).orderBy("ordinal").collect()
    assert [(r["sample_id"], r["response"]) for r in got] == [("b", "x"), ("a", "y")]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n[1]\n')
    errors = [r["error"] for r in records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), strict=False).orderBy("ordinal").collect()]
    assert errors[0] is None and errors[1].endswith("bad.jsonl:2: invalid JSON") and errors[2].endswith("bad.jsonl:3: each row must be an object")
    with pytest.raises(Exception, match="invalid JSON"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "old.json").write_text('[{"clean_path": "c.wav", "degradation_config": {"snr_db": 5}}, {"id": "x", "audio_path": "n.wav", "split": "eval"}]')
    items = derive.from_legacy(records.read_legacy(spark, str(tmp_path / "old.json"))).collect()
    assert [r["sample_id"] for r in items] == ["legacy-000000", "x"] and items[0]["target"]["actions"][0]["reduction_db"] == 12 and items[0]["split"] == "unassigned"
    counts = records.write_bundle({"sft": spark.createDataFrame([("a", "eval"), ("b", "train")], "sample_id string, split string")}, str(tmp_path / "out"))
    assert counts.first().asDict() == {"stage": "sft", "train": 1, "eval": 1, "test": 0}


def test_audio_files(spark, tmp_path):
    y = np.sin(np.arange(800) / 9) * 0.5
    (tmp_path / "train").mkdir()
    (tmp_path / "train/a.wav").write_bytes(audio.encode_wav(y, 8000))
    (tmp_path / "b.wav").write_bytes(audio.encode_wav(y, 16000))
    got = {r["path"][-5:]: r["y"] for r in audio.read_wavs(spark, str(tmp_path)).collect()}
    assert len(got["a.wav"]) == 1600 and got["b.wav"] == pytest.approx(y.tolist(), abs=1e-3)
    assert [r["path"][-11:] for r in audio.list_wavs(spark, str(tmp_path), 5).collect()] == ["train/a.wav"]


def test_streaming(spark, tmp_path):
    from strandline.streaming import scoring

    rows = [{"sample_id": i, "response": "not-json", "noise_type": "white", "at": "2024-01-01T00:00:00Z"} for i in ("a", "a", "b")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    query = scoring.write(scoring.scored(scoring.answers(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("bound", [1, 100])
@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_checked_join(spark, bound, how):
    from strandline.plans.runtime import join_small

    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 99), (None, 7)], "k string, v int")
    small = spark.createDataFrame([("hot", 1.0), ("warm", 2.0)], "k string, w double")
    got = join_small(big, small, ["k"], how, max_rows=bound, salts=5)
    want = big.join(small, "k", how)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_runs_and_profiles(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("b", 1, float("nan"))], "run string, step int, loss double")
    got = {r["run"]: r for r in runs.loss_series(rows).collect()}
    assert got["a"]["initial_loss"] == 2 and got["a"]["final_loss"] == 1 and got["a"]["all_losses_finite"] and not got["b"]["all_losses_finite"]
    assert runs.table_digest(rows).first() == runs.table_digest(rows.orderBy(F.desc("step"))).first() != runs.table_digest(rows.limit(1)).first()
    assert spark.range(1).select(runs.cross_entropy(F.array(F.lit(-1.0), F.lit(-0.5)))).first()[0] == 1.5


def test_batches_and_texts(spark):
    context = "contexts array<struct<noise_type:string,snr_db:double,reverb_rt60:double,bandlimit_hz:array<double>>>"
    one = ("white", 10.0, None, None)
    frame = spark.createDataFrame([(1, ["not-json", "{}"], [one, None]), (2, ["{}"], [one]), (3, ["{}", None], None), (4, [], []), (5, None, None)], f"batch int, completions array<string>, {context}")
    got = {r["batch"]: r["rewards"] for r in rewards.score_batches(frame).collect()}
    assert len(got[1]) == 2 and got[1][0] == 0.0 and got[4] == got[5] == [] and len(got[3]) == 2
    for texts in (["a", "b"], ["a"] * 3):
        with pytest.raises(Exception, match="same length"):
            rewards.score_batches(spark.createDataFrame([(1, texts, [one])], frame.schema)).collect()
    # without a context the noise is not given: half the diagnosis, though the answer says "none"
    says = json.dumps({"diagnosis": {"noise_type": "none", "reverb": False}, "actions": [{"type": "x", "reduction_db": 3}], "rationale": "r", "confidence": 0.5})
    shared = spark.createDataFrame([(1, [says, says], one)], f"batch int, completions array<string>, contexts {context.split(' array<')[1][:-1]}")
    none = spark.createDataFrame([(1, [says], None), (2, [says], [None]), (3, [says], [(None, None, None, None)])], frame.schema)
    assert {r["batch"]: r["rewards"] for r in rewards.score_batches(none).collect()} == {1: [0.9], 2: [0.9], 3: [1.0]}
    assert rewards.score_batches(shared).first()["rewards"] == [0.8, 0.8]
    texts = spark.createDataFrame([('{"actions": [{"gain_db": 1}]}',), ("plain words",), (None,)], "t string")
    out = [r[0] for r in texts.select(derive.corrupt_text(F.col("t"))).collect()]
    assert json.loads(out[0])["actions"] == [{"gain_db": -30.0}] and json.loads(out[1])["actions"][0]["reduction_db"] == 36 and out[2] is None
    words = spark.range(1).select(dsp.describe(waveforms.tone(F.lit(300.0), 0.5)).alias("d"), dsp.describe(F.array(F.lit(0.1).cast("float"))).alias("s")).first()
    assert dsp.MID_HEAVY in words["d"] and dsp.SPEECH in words["d"] and words["s"] == dsp.TOO_SHORT


def test_pooled_frames(spark):
    x = np.arange(44, dtype=np.float32).reshape(11, 4)
    got = spark.createDataFrame([(x.tolist(),), ([],)], "f array<array<float>>").select(waveforms.pooled_frames(F.col("f"), 2)).collect()
    assert np.array(got[0][0]).shape == (6, 4) and got[1][0] == []
    assert np.allclose(got[0][0], [x[i : i + 2].mean(axis=0) for i in range(0, 11, 2)])


def test_last_chosen_hash(spark):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(500)]
    frame = spark.createDataFrame([(h,) for h in hashes], "h string")
    for k in (1, 37, 500):
        assert kth_hash(frame, k, most=5, digits=1) == sorted(hashes)[k - 1]


def test_repeated_predictions_and_numbers_that_are_none(spark):
    ds = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_id string, response string")
    for rows, message in (([("a", "1"), ("a", "1")], "repeated prediction: a"), ([("a", None)], "without a response: a"), ([("", "1"), ("a", "2")], "without an id")):
        preds = spark.createDataFrame(rows, "sample_id string, response string")
        with pytest.raises(Exception, match=message):
            evaluate.unique_predictions(preds).collect()
    assert evaluate.coverage(ds, spark.createDataFrame([("a", "1"), ("a", "2")], "sample_id string, response string")).first()["dataset_samples"] == 2
    answer = '{"diagnosis": {}, "actions": [{"type": "spectral_subtraction", "reduction_db": 15}], "confidence": 1, "rationale": "r"}'
    parsed = spark.createDataFrame([(answer, float("nan")), (answer, 25.0)], "t string, snr double").select(rewards.parse_prescription("t").alias("p"), "snr")
    got = parsed.select(rewards.overprocessing_reward(F.col("p"), F.col("snr"))[0].alias("r")).collect()
    assert [r[0] for r in got] == [1.0, 0.75]
    metric = "struct<si_sdr:double,stoi:double,pesq:double,dnsmos:double,wer:double,speaker_similarity:double>"
    rows = spark.createDataFrame([((1.0, 0.5, 2.0, 2.0, 0.2, 0.5), [(float("nan"), 0.5, 2.0, 2.0, 0.2, 0.5)])], f"before {metric}, tries array<{metric}>")
    assert rows.select(closed_loop.decide(F.col("before"), F.col("tries"), 0).alias("d")).first()["d"]["decision"] == "rollback"


def test_release_faults(spark):
    matrix = spark.createDataFrame([(s, 2) for s in evaluate.STAGES], "stage string, num_samples long")
    answers = spark.createDataFrame([(s, "x") for s in evaluate.STAGES for _ in range(2)], "stage string, response string")
    good = {"method": "uniform_without_replacement", "seed": 42, "sample_ids_sha256": "a" * 64}
    assert evaluate.release_faults(matrix, answers, matrix, good, 2).count() == 0
    faults = evaluate.release_faults(matrix.filter("stage <> 'dpo'"), answers.filter("stage <> 'sft'"), matrix, good | {"method": "first", "sample_ids_sha256": "a"}, 2).collect()
    assert sorted(r[0] for r in faults) == ["dpo matrix: no records", "selection: no digest of ids", "selection: not uniform without replacement", "sft predictions: no records"]


def test_records_are_opened_once(spark):
    from strandline.operators import contracts

    found = contracts.audio_violations(F.col("record"))
    assert str(found).count("record,") == 1
    rows = spark.createDataFrame([("{}",), ("[1]",), ("null",), (None,), ('{"audio": {"sample_rate": 16000.5}, "target": {"actions": []}, "acoustics": null}',)], "t string")
    got = [set(r[0]) for r in rows.select(F.parse_json("t").alias("record")).select(found).collect()]
    assert got[1] == got[2] == got[3] == {"record: not object"} and {"audio: missing", "target: missing"} < got[0]
    assert {"audio.sample_rate: not integer", "target.actions: empty", "acoustics: not object", "audio.noisy_path: missing"} < got[4] and "acoustics.noise_type: missing" not in got[4]
