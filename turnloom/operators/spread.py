"""Spreading rows whose work is heavy though their bytes are few."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows by the keys to all cores.

    Adaptive execution joins small shuffle partitions by their bytes; for string alignment, whose
    cost grows with the square of a text, that would leave most cores idle. A fixed number of
    partitions is not joined.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
