"""Where lineage is cut: tables that several steps read are written once."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset
    on one machine (tests), a temporary folder is made and set; on a cluster that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let the driver's JVM notice finished jobs, so that executors drop their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared folder as Parquet, which takes less room than a checkpoint,
    and read from there."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
