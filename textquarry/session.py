"""Session defaults for local runs; a cluster brings its own."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "textquarry") -> SparkSession:
    """A local session with the settings the plans rely on (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # set comparisons cost far more than their bytes: small joins stay spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TEXTQUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def steady(spark: SparkSession) -> SparkSession:
    """Session settings that the plans need for right results.

    Spark 4.1 lets a union keep its inputs' common partitioning; when adaptive execution then coalesces one input and not
    the other, the query fails ("Can't zip RDDs with unequal numbers of partitions"). Unions here don't rely on it.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


#: The temporary folder of each local application; a running session's spark.checkpoint.dir can't be set.
_LOCAL: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority: one without a scheme lies in the cluster's default file system.

    Whoever opens files without Spark needs this form, as a bare path means a local disk to other libraries.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", found).rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, by spark.checkpoint.dir, with its scheme.

    Where none is set, a local session gets a temporary one; a cluster must name one, as its machines share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        application = spark.sparkContext.applicationId
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if application not in _LOCAL:
            _LOCAL[application] = f"file://{tempfile.mkdtemp(prefix='textquarry-')}"
        found = _LOCAL[application]
    return qualified(spark, found)
