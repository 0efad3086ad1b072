"""First elements of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_k(df: DataFrame, keys: list[str], column: str, k: int, name: str) -> DataFrame:
    """(keys, name): the ``k`` least distinct values of a column per group, sorted.

    Distinct values are numbered within their group and the numbers limited; Spark applies the limit before the shuffle too, so no
    more than ``k`` values of a group per task go anywhere.  Without keys: of the whole table.
    """
    rows = df.select(*keys, column).where(F.col(column).isNotNull()).distinct()
    if keys:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(column))).where(F.col("_n") <= k)
    else:
        rows = rows.orderBy(column).limit(k)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias(name))
