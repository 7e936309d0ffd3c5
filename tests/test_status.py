import json

from pyspark.sql import functions as F

from strandline.streaming import status


def source(spark, tmp_path, name, files):
    folder = tmp_path / name
    for i in range(files):
        spark.range(10 * i, 10 * i + 10 + i).coalesce(1).write.mode("append").parquet(str(folder))
    return folder


def start(spark, folder, tmp_path, name, of=lambda s: s):
    stream = of(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(folder)))
    return status.start_tracked(stream, name, str(tmp_path / f"{name}-rows"), str(tmp_path / f"{name}-state"), str(tmp_path / f"{name}.json"))


def test_state_after_a_failure_equals_that_of_an_undisturbed_run(spark, tmp_path):
    folder = source(spark, tmp_path, "in", 4)
    whole = status.finish(start(spark, folder, tmp_path, "whole"), str(tmp_path / "whole.json"))
    assert whole == {"name": "whole", "status": "complete", "batches": 4, "rows": 46, "last_rows": whole["last_rows"]}
    marker = tmp_path / "fail"
    marker.mkdir()

    def failing(stream):
        bad = F.when((F.col("id") >= 20) & (F.col("id") < 30), F.raise_error(F.lit("lost a task")).cast("long")).otherwise(F.col("id"))
        return stream.select(bad.alias("id"))

    first = status.finish(start(spark, folder, tmp_path, "cut", failing), str(tmp_path / "cut.json"))
    assert first["status"] == "failed" and first["error"] and first["batches"] < 4
    # the next run finds a batch that was written and told, but not committed, as if the driver had died there
    commits = sorted((tmp_path / "cut-state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    if commits:
        commits[-1].unlink()
        (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    second = status.finish(start(spark, folder, tmp_path, "cut"), str(tmp_path / "cut.json"))
    assert {k: v for k, v in second.items() if k not in ("name", "last_rows")} == {k: v for k, v in whole.items() if k not in ("name", "last_rows")}
    assert json.loads((tmp_path / "cut.json").read_text()) == second
    rows = [spark.read.parquet(str(tmp_path / f"{n}-rows")).select("id") for n in ("whole", "cut")]
    assert rows[0].count() == 46 and rows[0].exceptAll(rows[1]).count() == 0 == rows[1].exceptAll(rows[0]).count()


def test_status_of_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    query = start(spark, tmp_path / "none", tmp_path, "none")
    assert status.finish(query, str(tmp_path / "none.json"))["rows"] == 0
    assert status.read_status(spark, str(tmp_path / "other.json")) == {}
