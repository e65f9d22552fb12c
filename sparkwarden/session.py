"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Recording the call site of every expression costs more than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "sparkwarden", **conf: str) -> SparkSession:
    """A session with this package's defaults; ``master`` is left to spark-submit when unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own, as in tests, because there the driver and
    the executors are one process (a local cluster's executors are not).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows to the shared folder and reading them back.

    Lost executors cost nothing, because the rows are files.  A written table also has a known
    size, so joins with it are broadcast when it is small and shuffled evenly when it is not; an
    RDD checkpoint would keep neither and could pull the other side into its few partitions.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that is written once per application and read from then on."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
    if path not in _WRITTEN:
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _WRITTEN.add(path)
    return spark.read.parquet(path)


_WRITTEN: set[str] = set()
