"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tallywork

# Settings that change results or are needed for plans to hold at scale. Resources (memory, cores,
# shuffle partition count) belong to the cluster and are never set here.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship(*modules: ModuleType) -> None:
    """Send the functions of these modules to tasks by value, so that executors need no copy of the code."""
    for module in modules:
        cloudpickle.register_pickle_by_value(module)


ship(tallywork)


def local_session(app: str = "tallywork", cpus: str | int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench. On a cluster use the given session and `apply`."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TALLYWORK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.default.parallelism", "8")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
    )
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply(spark: SparkSession) -> SparkSession:
    """Put the required settings on a session someone else built."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach. The cluster names it in `spark.checkpoint.dir`.

    Only on a single machine, where that is unset, a temporary folder is made and recorded; on a cluster each executor would
    write to a disk of its own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        folder = spark.conf.get("spark.tallywork.local.folder", "") or ""
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallywork-")
        spark.conf.set("spark.tallywork.local.folder", folder)
    return folder.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of steps that nothing reads any more, on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def store_once(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back, for a result that several later steps read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, for a table that many later steps read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
