"""Session settings and the written intermediate that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "delaycohorts") -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # longer methods are never compiled by the JVM
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # cheaper plan building
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def short_methods(spark: SparkSession) -> None:
    """Keep generated methods below the size from which the JVM only interprets them, unless the session chose a limit."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit) == "65535":  # Spark's default
        spark.conf.set(limit, "8000")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a temporary one only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if configured.startswith("file:") and spark.sparkContext.master.startswith(("yarn", "k8s")):
            raise RuntimeError(f"spark.checkpoint.dir is {configured}; it has to be a folder that all hosts share")
        return configured
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="delaycohorts-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def work_folder(spark: SparkSession) -> str:
    """A new name in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/delaycohorts/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and read back.

    Used where several later stages need the same intermediate rows. The table survives lost
    executors, cuts the lineage, and gives the optimizer its true size.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
