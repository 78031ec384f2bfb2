"""Session defaults and the checkpoint rule shared by every job."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("lanewise")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", tempfile.mkdtemp(prefix="spark-"))))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    Only a local master without the setting falls back to a scratch folder: a
    machine-local path on a cluster would not outlive its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="spark-ckpt-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)
