"""Tables that a query writes down and reads again, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, local mode takes a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessella.scratch.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.scratch.dir", at)
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/tessella-core/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table: its plan ends here, and a lost executor costs a read."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows that a task of ``dealt`` takes, on average.
ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as its rows ask for, so that what a task holds does not grow with the input."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(parts, *keys)
