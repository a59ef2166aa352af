"""Session set-up for local runs, and tables that cut lineage."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", app: str = "reviewsieve", **conf) -> SparkSession:
    """A single-machine session for tests and benchmarks. On a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("REVIEWSIEVE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for lineage cuts. A local session without one gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    created = tempfile.mkdtemp(prefix="reviewsieve-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def materialize(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table read from there.

    One job, no lineage left, survives the loss of executors. ``schema`` reads it with user-defined types.
    The shuffle files of the job, which nothing reads again, go at its end instead of when the driver collects garbage.
    """
    spark = df.sparkSession
    path = "/".join([shared_dir(spark).rstrip("/"), "reviewsieve", f"{name}-{uuid.uuid4().hex}"])
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema or df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again, such as the last state of a loop."""
    jvm, files = table.sparkSession._jvm, table.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
