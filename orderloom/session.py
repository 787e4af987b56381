"""Session defaults for tests, the benchmark and small jobs.

On a cluster the operators run in whatever session they are given; nothing in
the library changes its settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "orderloom", **settings: str) -> SparkSession:
    """A local session with one shuffle partition per core."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    merged = {
        **_DEFAULTS,
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.driver.memory": "12g",
        **settings,
    }
    for key, value in merged.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for tables that one job writes and a later one reads.

    Lives under ``spark.checkpoint.dir``, or the context's checkpoint folder
    where only that is set; every executor can reach it. There is no fallback
    to a folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    unique = spark.sql("select uuid()").first()[0]
    return f"{root.rstrip('/')}/orderloom-{purpose}-{unique}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it from there, so that several passes compute it once."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
