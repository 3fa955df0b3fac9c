"""Session defaults: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tracewarden", **conf: str) -> SparkSession:
    """The running session, or a new one with the defaults."""
    builder = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpointed(df, purpose: str):
    """Cut the lineage of an iterative plan by a table in the folder that spark.checkpoint.dir names.

    The setting is read from the session; a folder of our own is made only where it is unset and Spark runs locally.
    """
    import tempfile
    import uuid

    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracewarden-")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df, *order: str):
    """df with rank from 0. Ranges are sorted in parallel; only the number of rows of each range meets on the driver."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    base, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p] = base
        base += sizes[p]
    start = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))])[F.col("_p")] if offsets else F.lit(0)
    return ranged.withColumn("rank", (start + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).cast("long")).drop("_p")
