"""Session construction and the settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "speechgrid", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time. On a cluster leave ``master`` and
    ``shuffle_partitions`` unset: the cluster names them."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    return b.getOrCreate()


def stage_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only where it is unset, as in local tests, a fresh
    folder under /tmp is used and remembered for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("speechgrid.stage.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("speechgrid.stage.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back. This cuts the lineage where a result feeds
    several branches (which would each compute it again), outlives any executor, keeps column pruning, and tells the
    planner its true size."""
    path = f"{stage_folder(df.sparkSession)}/speechgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
