"""Session factory with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables up to this size are dealt to all cores when their files make too few tasks.
SPREAD_BYTES = 1 << 30


def session(app: str = "webloom", **conf: str) -> SparkSession:
    """AQE with skew handling, UTC, ANSI mode; everything else (partitions, memory) is left to the cluster or to ``conf``."""
    base = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """A table that few tasks would read, as of one file with one row group, dealt to all cores before work on its texts.

    Only tables of at most SPREAD_BYTES are: larger ones have files enough, and a shuffle of them would cost more than it gives.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = len(df.inputFiles())
    return df.repartition(cores) if size <= SPREAD_BYTES and files < cores else df
