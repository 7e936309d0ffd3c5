"""Streams whose progress can be read as one JSON file, at any time and after any restart.

Every batch is written to a folder of its own number, over what an earlier try of the same batch has left, and then told in the state. A batch that is run again
after a failure so neither writes nor counts its rows twice, and the state after a restart is that of a run that was never disturbed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandline.sources.records import publish_json


def read_status(spark: SparkSession, path: str) -> dict:
    """The state of a run; empty before its first batch."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if files.exists(target) else {}


def start_tracked(stream: DataFrame, name: str, path: str, checkpoint: str, status_path: str, **trigger) -> StreamingQuery:
    """A query that writes ``stream`` below ``path`` and its state to ``status_path``; ``trigger`` as of Structured Streaming, all that is there by default.

    The state has the status (running, until ``finish`` has been called), the number of batches and rows, and the rows of the last batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        n = spark.read.parquet(folder).count()
        state = read_status(spark, status_path)
        if state.get("batches", 0) <= number:
            state = {"name": name, "batches": number + 1, "rows": state.get("rows", 0) + n, "last_rows": n}
        publish_json(spark, status_path, state | {"status": "running"})

    writer = stream.writeStream.queryName(name).foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def finish(query: StreamingQuery, status_path: str) -> dict:
    """Wait for a query and set its state to complete, or to failed with what ended it; returns the state."""
    spark, error = SparkSession.active(), None
    try:
        query.awaitTermination()
    except Exception as e:
        error = str(e).splitlines()[0]
    state = {k: v for k, v in read_status(spark, status_path).items() if k != "error"} or {"batches": 0, "rows": 0}
    state |= {"status": "complete"} if error is None else {"status": "failed", "error": error}
    publish_json(spark, status_path, state)
    return state
