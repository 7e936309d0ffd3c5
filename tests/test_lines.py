import json
import random
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.plans.runtime import shared_dir
from strandline.sources import arrays, lines


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "50"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def write(tmp_path, texts):
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.json").write_bytes(t.encode() if isinstance(t, str) else t)
    return str(tmp_path)


def test_numbers_equal_enumerate(spark, tmp_path, small_splits):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["\n", "  \n", f"{'x' * rng.randrange(90)}{i}é\n"]) for i in range(rng.randrange(200))) for _ in range(5)] + ["", "no end", "\n\n\n"]
    path = write(tmp_path, texts)
    want, ordinal = [], 0
    for i, t in enumerate(texts):
        for n, line in enumerate(t.split("\n"), 1):
            if line.strip():
                want.append((f"f{i}.json", n, ordinal, line))
                ordinal += 1
    got = lines.numbered_lines(spark, path)
    assert got.rdd.getNumPartitions() > 8
    assert sorted((r["file"].rsplit("/")[-1], r["line"], r["ordinal"], r["value"]) for r in got.collect()) == want
    chosen = lines.at_positions(got, spark.createDataFrame([(3,), (0,), (3,), (10**9,), (None,)], "at long"))
    assert sorted(r["value"] for r in chosen.collect()) == sorted(want[k][3] for k in (0, 3))


def value(rng, depth=0):
    texts = ["", "}", "{", "]", '"', "\\", '\\"', '"}', "},{", "a\\\\", "é ", "\n", "x" * rng.randrange(200), '{"a": [1]}']
    kind = rng.randrange(6 if depth < 4 else 3)
    if kind < 2:
        return "".join(rng.choice(texts) for _ in range(rng.randrange(4)))
    if kind == 2:
        return rng.choice([None, True, 1.5, -3, 10**20])
    if kind < 5:
        return {rng.choice(texts) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("indent", [None, 2])
def test_items_equal_a_plain_reader(spark, tmp_path, small_splits, indent):
    rng = random.Random(7)
    data = [[{"n": i, "v": value(rng), "w": value(rng)} for i in range(n)] for n in (0, 1, 2, 60, 150)]
    path = write(tmp_path, [json.dumps(d, ensure_ascii=bool(k % 2), indent=indent) + " \n" * (k % 3) for k, d in enumerate(data)])
    got = arrays.read_array(spark, path).collect()
    assert sorted((r["file"].rsplit("/")[-1], r["position"], json.dumps(json.loads(r["text"]), sort_keys=True)) for r in got) == sorted((f"f{k}.json", i, json.dumps(x, sort_keys=True)) for k, d in enumerate(data) for i, x in enumerate(d))


@pytest.mark.parametrize("text", ['{"a": [1]}', "[1, 2]", '[{"a": 1}, 2]', '[{"a": 1}', '[{"a": 1}]]', '["x"]', '[{"a": 1} {"b": 2}]', '[{"a": 1}, [{"b": 2}]]', '[{"a": }]', '[3, {"a": 1}]', '[{"a": "1}]', "null", '[{"a": 1},]', '[,{"a": 1}]'])
def test_other_texts_end_the_job(spark, tmp_path, text):
    with pytest.raises(Exception, match="no object|not a JSON array"):
        arrays.read_array(spark, write(tmp_path, [text])).collect()


def test_empty_arrays(spark, tmp_path):
    assert arrays.read_array(spark, write(tmp_path, ["[]", " [ \n ] ", ""])).count() == 0


def test_positions_of_items(spark, tmp_path):
    path = write(tmp_path, [json.dumps([{"i": i} for i in range(100)])])
    rows = arrays.read_array(spark, path).withColumnRenamed("position", "ordinal")
    wanted = lines.at_positions(rows, spark.range(0, 100, 7))
    assert sorted(json.loads(r["text"])["i"] for r in wanted.collect()) == list(range(0, 100, 7))
    assert rows.filter(F.get_json_object("text", "$.i").cast("long") != F.col("ordinal")).count() == 0


@pytest.mark.parametrize("many", [arrays.MANY_SPLITS, 2])
def test_items_across_splits_and_batches(spark, tmp_path, small_splits, monkeypatch, many):
    """Items of many splits, splits that begin inside texts full of structure, and states that go on from batch to batch."""
    monkeypatch.setattr(arrays, "MANY_SPLITS", many)
    rng = random.Random(11)
    odd = ["}", '"', "\\", "[{", "]}", "},{", '\\"', "é", "a" * 40]
    data = [[{"i": i, "v": "".join(rng.choice(odd) for _ in range(rng.choice([0, 3, 700])))} for i in range(n)] for n in (0, 1, 40, 25)]
    path = write(tmp_path, [json.dumps(d, ensure_ascii=False, separators=(",", ":") if k % 2 else None) for k, d in enumerate(data)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = arrays.read_array(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["file"].rsplit("/")[-1], r["position"], json.loads(r["text"])["v"]) for r in got) == sorted((f"f{k}.json", x["i"], x["v"]) for k, d in enumerate(data) for x in d)


def test_text_is_neither_written_nor_shuffled(spark, tmp_path):
    """Besides the pieces at the edges of splits, the text stays where it is read, whatever its size."""
    shared = Path(shared_dir(spark).removeprefix("file://")) / "strandline"
    before = {f for f in shared.rglob("*.parquet")}
    text = json.dumps([{"i": i, "v": random.Random(i).randbytes(400).hex()} for i in range(5000)])
    rows = arrays.read_array(spark, write(tmp_path, [text]))
    assert rows.count() == 5000
    assert sum(f.stat().st_size for f in set(shared.rglob("*.parquet")) - before) < len(text) / 50
    assert "file, split" not in re.sub(r"#\d+L?", "", "".join(re.findall(r"hashpartitioning\(.*?\)", rows._jdf.queryExecution().executedPlan().toString())))


@pytest.mark.parametrize("text", ['[{"a": 1}{"b": 2}]', '[{"a": 1}], {"b": 2}]', '[{"a": 1}], [{"b": 2}]', '[{"a": 1}, ["b"], {"c": 3}]'])
def test_what_stands_between_items_must_be_a_comma(spark, tmp_path, small_splits, text):
    long = text.replace("1", json.dumps("}" * 500))
    for at, t in (("short", text), ("long", long)):
        (tmp_path / at).mkdir()
        with pytest.raises(Exception, match="no object|not a JSON array"):
            arrays.read_array(spark, write(tmp_path / at, [t])).collect()


def test_states_do_not_depend_on_the_window():
    rng = random.Random(5)
    for _ in range(200):
        texts = ["".join(rng.choice(['"', "\\", "[", "{", "]", "a", "é"]) for _ in range(rng.randrange(12))) + "}" for _ in range(rng.randrange(1, 9))]
        odd = rng.random() < 0.5
        quoted, depth, want = odd, [0, 0], []
        for t in texts:
            slashes = 0
            for c in t:
                if c == '"' and slashes % 2 == 0:
                    quoted = not quoted
                depth[quoted] += (c in "[{") - (c in "]}")
                slashes = slashes + 1 if c == "\\" else 0
            want.append((quoted, *depth))
        for window in (1, 2, 5, 1000):
            data, ends, odds, depths = arrays._states(pa.array(["x", *texts])[1:], odd, window)
            assert data.tobytes().decode() == "".join(texts) and ends[-1] == len(data)
            assert list(zip(odds.tolist(), *depths.tolist(), strict=True)) == want
