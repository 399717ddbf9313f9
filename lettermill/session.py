"""Session settings the library relies on, and scratch tables on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results or bounded memory depend on. Everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # rows may be whole long texts: what a Python worker is sent at once stays small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(master: str = "local[*]", app: str = "lettermill", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session it gives."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**REQUIRED, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset and so is the master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="lettermill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/lettermill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to a new shared Parquet table and read it back.

    Survives the loss of any executor, and gives the optimiser true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over the session's number of shuffle partitions. Adaptive execution joins partitions by
    their packed bytes; it leaves these as they are, so that a task holds a small share where rows are widened or sorted next."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
