"""Session settings the engine relies on, and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own (tests, bench). A session given by a caller is left as it is.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.maxMetadataStringLength": "2000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "8", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("hitlore").config("spark.driver.memory", memory)
    for key, value in (LOCAL_CONF | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; where that is unset, a temporary one in local mode and an
    error on a cluster, whose nodes would each have a folder of their own."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all nodes share")
    if not os.environ.get("HITLORE_SHARED"):
        os.environ["HITLORE_SHARED"] = tempfile.mkdtemp(prefix="hitlore-")
    return "file://" + os.environ["HITLORE_SHARED"]


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop's objects."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def place(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, not made yet. It is in a folder of the application, which is deleted when that ends."""
    own = f"{shared_folder(spark)}/hitlore-{spark.sparkContext.applicationId}"
    fs, where = hadoop_path(spark, own)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder.

    An executor that is lost later takes nothing with it, because the files do not belong to it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows of df, written once to the shared folder in buckets of key, each sorted by it.

    Joins and aggregations by key of what is returned need no exchange. There are as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"hitlore_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, key)
    placed.write.bucketBy(buckets, key).sortBy(key).option("path", place(spark, name)).saveAsTable(name)
    return spark.table(name)
