"""Session helpers: table access, lineage cuts on shared storage, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, opened by Spark's own reader.

    Python workers on this machine are told where this library lies; on a cluster it is shipped with the job.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    A session in one process that names none gets a temporary folder; on a cluster that is an error, since
    no executor could read what another one wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to shared storage and read it back, so that lineage ends there.

    A lost executor then costs a reread of the written files, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing that is still to run reads them."""
    for df in written:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = 100_000,
    salts: int = 64,
) -> DataFrame:
    """Join ``big`` with a side that is unique on ``on`` and usually small.

    The size of ``small`` is counted first; it should be a written table, so that this reads its rows and does
    not run its plan once more. Up to ``max_rows`` rows it is broadcast; beyond that
    it is replicated over ``salts`` salts, and ``big`` is dealt over them by a row hash, so that a
    key which holds a third of the rows is still spread over many tasks.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    salt = "__salt"
    salted = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in big.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int"))
    return left.join(salted, [*on, salt], how).drop(salt)
