import json

import pytest
from pyspark.sql import functions as F

from strandline.functions.canonical import public_digest
from strandline.functions.prescriptions import decode, unfenced
from strandline.operators import configs, evaluate

STAGES = {s: {"per_device_train_batch_size": 1} for s in configs.STAGES}
GOOD = {"project": {"seed": 1}, "model": {"name_or_path": "m"}, "data": {}, "training": {"stages": STAGES}}


def faults(spark, value):
    rows = spark.createDataFrame([("c", value if isinstance(value, str) or value is None else json.dumps(value))], "name string, text string")
    return sorted(f"{r['path']}: {r['fault']}" for r in configs.config_faults(rows).collect())


def test_configurations_against_limits(spark, tmp_path):
    assert faults(spark, GOOD) == []
    bad = {"project": {"seed": -1}, "model": {"name_or_path": " "}, "data": 3, "training": {"stages": {**STAGES, "dpo": {"label_smoothing": 0.5, "per_device_train_batch_size": "x"}}}}
    assert faults(spark, bad) == ["data: not an object", "model.name_or_path: not a text", "project.seed: out of bounds", "training.stages.dpo.label_smoothing: out of bounds", "training.stages.dpo.per_device_train_batch_size: not a number"]
    for text in ("[", None, "[1]"):
        assert ": not an object" in faults(spark, text)
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=1))
    read = configs.read_configs(spark, str(tmp_path))
    assert read.first()["name"] == "a.json" and configs.config_faults(read).count() == 0
    digests = spark.createDataFrame([(json.dumps(GOOD),), (json.dumps(GOOD | {"_private": 1}),), (json.dumps(GOOD | {"more": 1}),)], "t string").select(public_digest(F.col("t"))).collect()
    assert digests[0] == digests[1] != digests[2]


def test_stage_plans(spark):
    config = {"training": {"stages": {"grpo": {"per_device_train_batch_size": 6, "num_generations": 4, "gradient_accumulation_steps": 3}}}}
    rows = spark.createDataFrame([("c", json.dumps(config))], "name string, text string")
    counts = spark.createDataFrame([("grpo", "train", 5), ("grpo", "eval", 0)], "stage string, split string, n int")
    plan = configs.stage_plans(rows, counts).first()
    assert plan["effective_batch_size"] == 18 and plan["faults"] == ["grpo eval: empty", "grpo: batch not divisible by generations"]


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_configurations_are_never_broadcast_or_shuffled(spark):
    rows = spark.createDataFrame([("c", json.dumps(GOOD)), ("c", json.dumps({**GOOD, "data": None})), ("d", "[")], "name string, text string")
    found = configs.config_faults(rows)
    # of the join only the limits, one row of literals, may be broadcast: the other side holds all values of all configurations
    below = plan_of(found).split("rightHint=(strategy=broadcast)")
    assert len(below) == 2 and plan_of(found).count("Join ") == 1 and "Aggregate" not in plan_of(found)
    # configurations of one name are judged by themselves
    assert sorted((r["name"], r["path"], r["fault"]) for r in found.collect() if r["name"] == "c") == [("c", "data", "missing")]
    twice = [("data", "object", None, None, True), ("data", "text", None, None, False)]
    assert sorted((r["name"], r["fault"]) for r in configs.config_faults(rows, twice).collect()) == [("c", "missing"), ("c", "not a text"), ("d", "missing"), ("d", "not an object")]
    assert configs.config_faults(rows.limit(2), []).count() == 0


def test_stage_plans_keep_no_state_of_configurations(spark):
    two = [("c", json.dumps({"training": {"stages": {"sft": {"per_device_train_batch_size": n, "gradient_accumulation_steps": "2"}}}})) for n in (3, 5)]
    rows = spark.createDataFrame([*two, ("d", "["), ("e", json.dumps({"training": {"stages": {"dpo": {"other": 1}}}}))], "name string, text string")
    counts = spark.createDataFrame([("sft", "train", 5), ("sft", "eval", 1)], "stage string, split string, n int")
    plans = configs.stage_plans(rows, counts)
    assert "Aggregate" not in plan_of(plans)
    assert sorted((r["name"], r["stage"], r["effective_batch_size"], *r["faults"]) for r in plans.collect()) == [("c", "sft", 6), ("c", "sft", 10), ("e", "dpo", 0, "dpo train: empty", "dpo eval: empty")]


def test_launch_profiles(spark):
    good = {"zero_optimization": {"stage": 2, "offload_optimizer": {"device": "cpu"}}, "_portfolio_contract": {"declared_world_size": 1, "single_gpu_only": True}}
    bad = {"zero_optimization": {"stage": 2, "offload_param": {"device": "disk"}}, "bf16": {"enabled": True}, "fp16": {"enabled": True}}
    rows = spark.createDataFrame([(n, json.dumps(p), w) for n, p, w in (("good", good, 1), ("two", good, 2), ("bad", bad, 1), ("none", {}, 0))], "name string, text string, world_size int")
    got = {}
    for r in configs.profile_faults(rows).collect():
        got.setdefault(r["name"], []).append(r["fault"])
    assert "good" not in got and got["two"] == ["declared world size: differs", "single process only"]
    assert sorted(got["bad"]) == ["bf16 and fp16: both enabled", "contract: missing", "offload_param: needs stage 3", "offload_param: unknown device"]
    assert got["none"] == ["world size: under 1", "zero_optimization: not an object", "contract: missing"]


@pytest.mark.parametrize(("text", "body"), [("x", "x"), ("```json\n{}\n```", "{}"), ("```\n{}", "{}"), ("```", ""), ("```{}```", ""), ("```\na\u2028b\r\n  ```  ", "a\nb"), ("```\n```\n```", "```"), ("```\n\n", "")])
def test_fences(text, body):
    assert unfenced(text) == body


def test_decoded_fences():
    assert decode('```json\n{"a":\u2028 1}\n```') == {"a": 1} and decode("```\n[1]\n```") is None and decode(None) is None


def package(spark, edit=None, drop=()):
    n = 3
    texts = {
        evaluate.MANIFEST: {"stage": "grpo", "status": "complete"},
        evaluate.CARD: "---\nlicense: mit\n---\n# Final",
        evaluate.EVALUATION: {"status": "complete", "records": n, "selection": {"method": "uniform_without_replacement", "seed": 42, "sample_ids_sha256": "a" * 64}, "stages": dict.fromkeys(evaluate.STAGES, {})},
        **{f"{s}_reward_report.json": {"num_samples": n} for s in evaluate.STAGES},
        **{f"{s}_predictions.jsonl": "{}\n" * n for s in evaluate.STAGES},
    }
    if edit:
        edit(texts)
    names = [f for f in (*evaluate.ADAPTER, *texts) if f not in drop]
    lines = [(f, i, v) for f in names if f in texts for i, v in enumerate((texts[f] if isinstance(texts[f], str) else json.dumps(texts[f], indent=1)).split("\n"))]
    found = evaluate.package_faults(spark.createDataFrame([(f,) for f in names], "file string"), spark.createDataFrame(lines, "file string, line int, value string"), n)
    return sorted(r[0] for r in found.collect())


def put(name, path, value):
    def edit(texts):
        at = texts[name]
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value

    return edit


def test_release_packages(spark):
    assert package(spark) == []
    everything = [*evaluate.ADAPTER, evaluate.MANIFEST, evaluate.CARD, evaluate.EVALUATION, *[f"{s}_{a}" for s in evaluate.STAGES for a in evaluate.ARTIFACTS]]
    assert package(spark, drop=everything[1:]) == sorted(f"{f}: missing" for f in everything[1:])
    e = evaluate.EVALUATION
    cases = [
        (put(evaluate.MANIFEST, ["stage"], "dpo"), f"{evaluate.MANIFEST}: no finished grpo run"), (put(evaluate.MANIFEST, ["status"], None), f"{evaluate.MANIFEST}: no finished grpo run"),
        (lambda t: t.update({evaluate.CARD: "license: mit FINAL_EVAL_TABLE"}), f"{evaluate.CARD}: final evaluation pending"), (lambda t: t.update({evaluate.CARD: "license: apache"}), f"{evaluate.CARD}: no licence"),
        (put(e, ["status"], "running"), f"{e}: not complete"), (put(e, ["stages"], {"base": {}}), f"{e}: other stages"), (put(e, ["records"], 2), f"{e}: other number of records"),
        (put(e, ["selection", "method"], "first"), f"{e}: not uniform without replacement"), (put(e, ["selection", "seed"], 7), f"{e}: another seed"), (put(e, ["selection", "sample_ids_sha256"], "a"), f"{e}: no digest of ids"),
        (put("dpo_reward_report.json", ["num_samples"], 4), "dpo_reward_report.json: other number of samples"), (lambda t: t.update({"sft_predictions.jsonl": "{}\n \n{}\n"}), "sft_predictions.jsonl: 2 rows"), (lambda t: t.update({"sft_predictions.jsonl": ""}), "sft_predictions.jsonl: 0 rows"),
    ]
    for edit, fault in cases:
        assert package(spark, edit) == [fault]
