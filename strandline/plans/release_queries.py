"""Queries of configurations, launch profiles, batches of answers and release packages, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import configs, contracts, derive, evaluate
from strandline.operators.rewards import score_batches
from strandline.plans.bridge import BRIDGE_SQL, bridge
from strandline.plans.runtime import table


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline configuration for each customer, sound or not by its key."""
    k = F.col("c_custkey")
    stage = F.format_string('{"per_device_train_batch_size": %d, "gradient_accumulation_steps": %d, "num_generations": 4}', (k % 6).cast("int"), (k % 3 + 1).cast("int"))
    dpo = F.concat(F.lit('{"per_device_train_batch_size": "2", "label_smoothing": '), (k % 8 / 10.0).cast("string"), F.lit("}"))
    sft = F.when(k % 7 != 0, F.concat(F.lit('"sft": '), stage, F.lit(", "))).otherwise("")
    model = F.when(k % 5 == 0, '" "').when(k % 5 == 1, "7").otherwise('"m"')
    data = F.when(k % 11 != 0, '"data": {}, ').otherwise("")
    body = F.concat(F.lit('{"project": {"seed": '), (k % 4 - 1).cast("string"), F.lit('}, "model": {"name_or_path": '), model, F.lit("}, "), data, F.lit('"training": {"stages": {'), sft, F.lit('"dpo": '), dpo, F.lit(', "grpo": '), stage, F.lit("}}}"))
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("name"), F.when(k % 13 == 0, "[1").otherwise(body).alias("text"))


def config_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each configuration, path by path."""
    return configs.config_faults(_configs(spark, sf_dir))


def stage_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective batches and faults of the stages of each configuration, over datasets of which one is empty."""
    counts = table(spark, sf_dir, "region").select(F.explode(F.array(*map(F.lit, configs.STAGES))).alias("stage"), F.explode(F.array(F.lit("train"))).alias("split"), F.lit(1).alias("n"))
    more = counts.filter("stage <> 'dpo'").withColumn("split", F.lit("eval"))
    plans = configs.stage_plans(_configs(spark, sf_dir), counts.unionByName(more))
    return plans.select("name", "stage", "effective_batch_size", F.array_join("faults", "|").alias("faults"))


def launch_profile_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a launch profile for each customer."""
    k = F.col("c_custkey")
    param = F.when(k % 5 == 0, ', "offload_param": {"device": "cpu"}').when(k % 5 == 1, ', "offload_param": {"device": "disk"}').otherwise("")
    zero = F.concat(F.lit('{"stage": '), (k % 6).cast("string"), F.when(k % 7 == 0, ', "offload_optimizer": true').otherwise(', "offload_optimizer": {"device": "nvme"}'), param, F.lit("}"))
    contract = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit(', "_portfolio_contract": {"declared_world_size": '), (k % 3).cast("string"), F.when(k % 4 == 0, ', "single_gpu_only": true').otherwise(""), F.lit("}")))
    halves = F.concat(F.lit(', "bf16": {"enabled": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit('}, "fp16": {"enabled": '), F.when(k % 10 < 5, "true").otherwise("false"), F.lit("}"))
    text = F.concat(F.lit('{"zero_optimization": '), F.when(k % 17 == 0, "3").otherwise(zero), contract, halves, F.lit("}"))
    return configs.profile_faults(table(spark, sf_dir, "customer").select(k.alias("name"), text.alias("text"), (k % 4).alias("world_size")))


def batch_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of eight answers at a time: with a context each, without any, with some that are null, and with one for all."""
    rows = bridge(spark, sf_dir).withColumn("batch", F.floor(F.col("event_id") / 8))
    given = F.struct("noise_type", "snr_db", "reverb_rt60", "bandlimit_hz")
    own = F.when((F.col("batch") % 4 != 2) | (F.col("event_id") % 2 == 0), given)
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "response", own.alias("context"))))
    groups = rows.groupBy("batch").agg(ordered.alias("r"))
    contexts = F.transform("r", lambda x: x["context"])
    groups = groups.select("batch", F.transform("r", lambda x: x["response"]).alias("completions"), F.when(F.col("batch") % 4 != 1, contexts).alias("contexts"))
    shared = groups.filter("batch % 4 = 3").drop("contexts")
    one = F.struct(F.lit("white").alias("noise_type"), F.lit(25.0).alias("snr_db"), F.lit(0.0).alias("reverb_rt60"), F.lit(None).cast("array<double>").alias("bandlimit_hz"))
    found = score_batches(groups.filter("batch % 4 <> 3")).unionByName(score_batches(shared.withColumn("contexts", one)))
    return found.select("batch", F.size("rewards").alias("n"), F.array_join(F.transform("rewards", lambda x: F.format_string("%.5f", F.round(x, 5))), ",").alias("rewards"))


def release_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that keeps a package back with answers of all events, of which many a file or value is not as it should be."""
    rows = bridge(spark, sf_dir).select("event_id", "k", "response")
    n = rows.count()
    stages = F.explode(F.array(*map(F.lit, evaluate.STAGES)))
    answers = rows.select(stages.alias("stage"), "*").filter((F.col("stage") != "sft") | (F.col("k") % 17 != 0))
    blank = (F.col("stage") == "grpo") & (F.col("k") == 5)
    answers = answers.select(F.concat("stage", F.lit("_predictions.jsonl")).alias("file"), F.col("event_id").alias("line"), F.when(blank, " ").otherwise(F.to_json(F.struct("response"))).alias("value"))
    small = [
        (evaluate.MANIFEST, '{"stage": "grpo",\n "status": "running"}'),
        (evaluate.CARD, f"---\nlicense: other\n---\n{evaluate.PENDING}"),
        (evaluate.EVALUATION, f'{{"status": "complete", "stages": {{"base": {{}}, "sft": {{}}, "grpo": {{}}}}, "records": {n}, "selection": {{"method": "first", "seed": 42, "sample_ids_sha256": "{"a" * 63}"}}}}'),
        *[(f"{s}_reward_report.json", f'{{"num_samples": {n + (s == "sft")}}}') for s in evaluate.STAGES if s != "dpo"],
    ]
    texts = spark.createDataFrame([(name, i, line) for name, text in small for i, line in enumerate(text.split("\n"), 1)], "file string, line long, value string")
    lines = answers.unionByName(texts)
    files = lines.select("file").distinct().unionByName(spark.createDataFrame([(evaluate.ADAPTER[0],)], "file string"))
    return evaluate.package_faults(files, lines, n)


def unsafe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of each event as a text, made unsafe; some have no JSON, no object, or other actions."""
    k = F.col("k")
    text = (
        F.when(k % 5 == 0, "no json").when(k % 5 == 1, "[1]").when(k % 5 == 2, '{"actions": {"gain_db": 1}, "z": 1}').when(k % 5 == 3, '{"actions": [{"gain_db": 1}, 3]}').otherwise('{"actions": [7], "confidence": 1}')
    )
    return bridge(spark, sf_dir).select("sample_id", derive.corrupt_text(text).alias("rejected"))


#: For each edit of a record that the query below makes: the JSON that takes the place of a part (none: the part goes), and what is found wrong.
EDITS = [
    ("schema_version", '"x"', "schema_version"), ("sample_id", "5", "sample_id: not string"), ("sample_id", None, "sample_id: missing"), ("audio", None, "audio: missing"), ("audio", '"a"', "audio: not object"),
    ("noisy_path", None, "audio.noisy_path: missing"), ("noisy_path", "1", "audio.noisy_path: not string"), ("sample_rate", None, "audio.sample_rate: missing"), ("sample_rate", '"16000"', "audio.sample_rate: not integer"),
    ("sample_rate", "16000.5", "audio.sample_rate: not integer"), ("sample_rate", "100", "audio.sample_rate: outside [8000, 192000]"), ("duration_seconds", "0", "audio.duration_seconds: not positive"),
    ("duration_seconds", '"3"', "audio.duration_seconds: not positive"), ("acoustics", None, "acoustics: missing"), ("acoustics", "[]", "acoustics: not object"), ("noise_type", None, "acoustics.noise_type: missing"), ("noise_type", '" "', "acoustics.noise_type: empty"),
    ("noise_type", "3", "acoustics.noise_type: not string"), ("snr_db", "81", "acoustics.snr_db: outside [-30, 80]"), ("snr_db", '"x"', "acoustics.snr_db: outside [-30, 80]"), ("target", None, "target: missing"), ("target", "[]", "target: not object"),
    ("diagnosis", None, "target.diagnosis: missing"), ("diagnosis", "[]", "target.diagnosis: not object"), ("actions", None, "target.actions: missing"), ("actions", "{}", "target.actions: not array"), ("actions", "[]", "target.actions: empty"),
    ("rationale", None, "target.rationale: missing"), ("rationale", "null", "target.rationale: not string"), ("split", '"dev"', "split: unknown"), ("", "[1]", "record: not object"),
]


def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a manifest, each with one edit or none; all messages of the contract come up."""
    edit = F.col("event_id") % (len(EDITS) + 3)

    def part(name: str, text: Column) -> Column:
        changed = F.lit(None).cast("string")
        for n, (where, by, _) in enumerate(EDITS):
            if where == name and by is not None:
                changed = F.coalesce(changed, F.when(edit == n, by))
        gone = edit.isin([n for n, (where, by, _) in enumerate(EDITS) if where == name and by is None] or [-1])
        return F.when(~gone, F.concat(F.lit(f'"{name}": '), F.coalesce(changed, text)))

    def all_of(*parts: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))

    inner = {
        "audio": all_of(part("noisy_path", F.lit('"x.wav"')), part("sample_rate", F.lit("16000")), part("duration_seconds", F.lit("3.5"))),
        "acoustics": all_of(part("noise_type", F.lit('"white"')), part("snr_db", F.lit("8"))),
        "target": all_of(part("diagnosis", F.lit("{}")), part("actions", F.lit('[{"type": "x"}]')), part("rationale", F.lit('""'))),
    }
    whole = all_of(part("schema_version", F.lit(f'"{contracts.AUDIO_SCHEMA}"')), part("sample_id", F.lit('"a"')), part("split", F.lit('"train"')), *[part(k, v) for k, v in inner.items()])
    record = F.parse_json(F.when(edit == len(EDITS) - 1, EDITS[-1][1]).otherwise(whole))
    rows = table(spark, sf_dir, "events").select("event_id", record.alias("record"))
    return rows.select("event_id", F.array_join(contracts.audio_violations(F.col("record")), "|").alias("violations"))


def _fault(*items: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {found} THEN '{said}' END" for said, found in items) + "], lambda x: x IS NOT NULL)"


def _total(noise: str, clean: str) -> str:
    """The total of an answer in another context than its own; the noise is the text of an SQL value, or empty for none."""
    match = f"(CASE WHEN guess = {noise} THEN 1.0 WHEN contains(guess, {noise}) OR contains({noise}, guess) THEN 0.75 ELSE 0.0 END) * CASE WHEN k % 3 = 0 THEN 0.75 ELSE 1.0 END" if noise else "0.5"
    untyped = f"({noise} IN ('white', 'pink', 'cafe', 'hvac') AND n_act <= 0)::INT" if noise else "0"
    red = "(red + 14 * (n_act = 2)::INT)"
    return f"""round_even((format + CASE WHEN NOT ok THEN 0.0 ELSE {match} END + parameter_bounds
  + CASE WHEN NOT ok THEN 0.0 ELSE greatest(0.0, 1.0 - 0.5 * {untyped} - 0.25 * (n_act > 0 AND kind = 'highpass' AND low > 300)::INT) END
  + CASE WHEN NOT ok THEN 0.0 WHEN n_act <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - (CASE WHEN red > 18 THEN least(0.5, (red - 18) / 24) ELSE 0 END)
     - 0.25 * (abs(gain) > 18)::INT - 0.25 * (kind = 'highpass' AND low > 180)::INT - (CASE WHEN {red} > 30 THEN least(0.5, ({red} - 30) / 30) ELSE 0 END)
     - 0.25 * ({clean} AND {red} > 12)::INT) END::DOUBLE) / 5, 6)"""


QUERIES = {q.__name__: q for q in (config_faults, stage_plans, launch_profile_faults, batch_rewards, release_package, unsafe_texts, contract_faults)}
_K = "k AS (SELECT c_custkey AS k FROM customer)"
ORACLE_SQL = {
    "contract_faults": f"SELECT event_id, coalesce({[said for _, _, said in EDITS]}[event_id % {len(EDITS) + 3} + 1], '') AS violations FROM events",
    "config_faults": f"""WITH {_K}, f AS (SELECT k, CASE WHEN k % 13 = 0 THEN
  ['|not an object', 'project|missing', 'model|missing', 'data|missing', 'training|missing', 'project.seed|missing', 'model.name_or_path|missing', 'training.stages.sft|missing', 'training.stages.dpo|missing', 'training.stages.grpo|missing',
   'training.stages.sft.per_device_train_batch_size|missing', 'training.stages.dpo.per_device_train_batch_size|missing', 'training.stages.grpo.per_device_train_batch_size|missing']
  ELSE {_fault(("project.seed|out of bounds", "k % 4 = 0"), ("model.name_or_path|not a text", "k % 5 < 2"), ("data|missing", "k % 11 = 0"), ("training.stages.sft|missing", "k % 7 = 0"),
       ("training.stages.sft.per_device_train_batch_size|missing", "k % 7 = 0"), ("training.stages.sft.per_device_train_batch_size|out of bounds", "k % 7 <> 0 AND k % 6 = 0"),
       ("training.stages.grpo.per_device_train_batch_size|out of bounds", "k % 6 = 0"), ("training.stages.dpo.label_smoothing|out of bounds", "k % 8 >= 5"))} END AS f FROM k)
SELECT k::VARCHAR AS name, string_split(x, '|')[1] AS path, string_split(x, '|')[2] AS fault FROM (SELECT k, unnest(f) AS x FROM f)""",
    "stage_plans": f"""WITH {_K} SELECT k::VARCHAR AS name, stage, (CASE stage WHEN 'dpo' THEN 2 ELSE (k % 6) * (k % 3 + 1) END)::BIGINT AS effective_batch_size,
  CASE WHEN stage = 'dpo' THEN 'dpo eval: empty' WHEN stage = 'grpo' AND (k % 6) % 4 <> 0 THEN 'grpo: batch not divisible by generations' ELSE '' END AS faults
FROM k, (VALUES ('sft'), ('dpo'), ('grpo')) s(stage) WHERE k % 13 <> 0 AND (stage <> 'sft' OR k % 7 <> 0)""",
    "launch_profile_faults": f"""WITH {_K}, z AS (SELECT *, k % 17 <> 0 AS zero, k % 9 <> 0 AS told, k % 4 AS size, k % 3 AS declared FROM k),
f AS (SELECT k, {_fault(("world size: under 1", "size < 1"), ("zero_optimization: not an object", "NOT zero"), ("zero_optimization.stage: unknown", "zero AND k % 6 > 3"), ("contract: missing", "NOT told"),
  ("declared world size: not positive", "told AND declared < 1"), ("declared world size: differs", "told AND declared >= 1 AND declared <> size"), ("single process only", "told AND k % 4 = 0 AND size <> 1"),
  ("bf16 and fp16: both enabled", "k % 2 = 0 AND k % 10 < 5"), ("offload_param: needs stage 3", "zero AND k % 6 <> 3 AND k % 5 < 2"), ("offload_optimizer: unknown device", "zero AND k % 7 = 0"),
  ("offload_param: unknown device", "zero AND k % 5 = 1"))} AS f FROM z)
SELECT k AS name, unnest(f) AS fault FROM f""",
    "batch_rewards": f"""WITH {BRIDGE_SQL},
t AS (SELECT event_id, event_id // 8 AS batch, CASE WHEN (event_id // 8) % 4 = 1 OR ((event_id // 8) % 4 = 2 AND event_id % 2 = 1) THEN {_total("", "false")}
   WHEN (event_id // 8) % 4 = 3 THEN {_total("'white'", "true")} ELSE total END AS total FROM s)
SELECT batch, count(*)::INTEGER AS n, string_agg(printf('%.5f', round(total, 5)), ',' ORDER BY event_id) AS rewards FROM t GROUP BY batch""",
    "release_package": f"""WITH {BRIDGE_SQL}
SELECT unnest(['adapter_model.safetensors: missing', 'dpo_reward_report.json: missing', 'stage_manifest.json: no finished grpo run', 'MODEL_CARD.md: final evaluation pending', 'MODEL_CARD.md: no licence',
  'stage_matrix.json: other stages', 'stage_matrix.json: not uniform without replacement', 'stage_matrix.json: no digest of ids', 'sft_reward_report.json: other number of samples']) AS fault
UNION ALL SELECT 'sft_predictions.jsonl: ' || count(*) || ' rows' FROM b WHERE k % 17 <> 0
UNION ALL SELECT 'grpo_predictions.jsonl: ' || count(*) || ' rows' FROM b WHERE k <> 5""",
    "unsafe_texts": f"""WITH {BRIDGE_SQL}, u AS (SELECT sample_id, k % 5 AS c, '"rationale": "{derive.UNSAFE_RATIONALE}"' AS r,
  '{{"high_hz": 8000, "low_hz": 0, "reduction_db": 36.0, "type": "spectral_subtraction"}}' AS d FROM b)
SELECT sample_id, CASE WHEN c < 2 THEN '{{"actions": [{{"reduction_db": 36.0, "type": "spectral_subtraction"}}], "confidence": 0.99, "diagnosis": {{"noise_type": "unknown"}}, ' || r || '}}'
  WHEN c = 2 THEN '{{"actions": [' || d || '], "confidence": 0.99, ' || r || ', "z": 1}}' WHEN c = 3 THEN '{{"actions": [{{"gain_db": -30.0}}, 3], "confidence": 0.99, ' || r || '}}'
  ELSE '{{"actions": [' || d || '], "confidence": 0.99, ' || r || '}}' END AS rejected FROM u""",
}
