"""Session settings this engine relies on, and checkpoints in the cluster's shared folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Correctness does not depend on these; AQE sizes and splits shuffle partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # call-site capture costs a JVM round trip per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(master: str | None = None, app: str = "tabia", **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder, its lineage cut, to be read several times."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder, computed once; the folder's owner clears it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
