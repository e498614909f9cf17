"""Tables that an operator writes once and reads several times.

They live in the folder the cluster names in ``spark.checkpoint.dir``, which the
driver and all executors share, so a lost executor loses nothing that is written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where none is set (tests), a local one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        made = tempfile.TemporaryDirectory(prefix="cladeframe-", ignore_cleanup_errors=True)
        atexit.register(made.cleanup)
        _own[app] = made.name
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cladeframe/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(df: DataFrame) -> int:
    """Partitions for a shuffle that the caller keys itself."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with a number, such that no column of ``df`` has it."""
    held = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}{k}" for k in range(len(held) + 1))) if x.lower() not in held)


#: Rows of a table of ids that is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sized_broadcast(table: DataFrame) -> DataFrame:
    """``table`` (narrow and stored), marked for broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in the one column of ``ids``; null ids stay."""
    name = fresh(docs, "gone")
    gone = stored(ids.select(F.col(ids.columns[0]).alias(name)).distinct(), "gone")
    return docs.join(sized_broadcast(gone), docs[id_col] == F.col(name), "left_anti")


def joined_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` (stored) with the one row of ``right`` that has their key.

    Keys that hold more than a quarter of a task's fair share of the rows, at most four
    a task whatever the data, take their row by broadcast; all others by shuffle.
    """
    share = max(1, left.count() // (4 * parallelism(left)))
    hot = stored(left.groupBy(key).count().filter(F.col("count") > share).select(key).join(right, key), "hot")
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(right, key))
