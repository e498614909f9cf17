"""Broadcasts behind a count of what is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1_000_000
BYTES = 64 << 20
TASK_ROWS = 500_000  # that one task sorts


def small(table: DataFrame, rows: int = ROWS) -> DataFrame:
    """``table``, marked for broadcast if it has at most so many rows; else joins move it by key."""
    return F.broadcast(table) if len(table.limit(rows + 1).select(F.lit(1).alias("x")).groupBy().count().filter(F.col("count") <= rows).take(1)) else table


def rows_of(table: DataFrame, wide: str) -> int:
    """Rows of ``table`` that may be broadcast when its column ``wide`` counts: as many as it has, if they fit in BYTES."""
    row = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(wide)), F.lit(0)).alias("b")).first()
    return int(row["n"]) if row["b"] <= BYTES else 0


def by_key(table: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """``table`` by ``key`` in as many partitions as keep about so many rows in each."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(n, -(-table.count() // rows)), key)
