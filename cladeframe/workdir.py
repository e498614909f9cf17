"""A folder for files that a plan writes and reads again."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which a cluster's machines share; where that is unset, a local folder that goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        if app not in _own:
            made = tempfile.TemporaryDirectory(prefix="cladeframe-", ignore_cleanup_errors=True)
            atexit.register(made.cleanup)
            _own[app] = made.name
        folder = _own[app]
    return f"{folder.rstrip('/')}/cladeframe/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df, path: str, required: list[str] = (), rerun: bool = False):
    """A stage's Parquet table: the one at ``path`` if it is there, complete and has the columns, else written now."""
    spark = df.sparkSession
    if not rerun:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.parquet(path)
            if set(required) <= set(known.columns):
                return known
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def listed(spark: SparkSession, paths: Sequence[str]) -> list[list]:
    """Name, length and time of change of every file below the paths, in order."""
    out = []
    for path in sorted(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(place):
            out.append([path, -1, -1])
            continue
        found = system.listFiles(place, True)
        while found.hasNext():
            f = found.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], inputs: Sequence[str] = (), settings: dict | None = None, rerun: bool = False) -> DataFrame:
    """The table that ``make`` gives, written once below ``path`` for its inputs' files, settings and schema.

    A stage is a folder named by a digest of the three; what changes one of them makes
    another. It is written aside and takes its name by a rename when it is complete, so a stage
    that broke off is never read, and of two writers one wins. ``rerun`` writes it anew.
    """
    df = make()
    said = {"inputs": listed(spark, inputs), "settings": settings or {}, "schema": df.schema.jsonValue()}
    digest = hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    done = jvm.Path(f"{path.rstrip('/')}/{digest}")
    system = done.getFileSystem(conf)
    if rerun or not system.exists(done):
        aside = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        if rerun and system.exists(done):
            system.delete(done, True)
        if not system.rename(jvm.Path(aside), done) and not system.exists(done):
            raise OSError(f"{aside} can't be renamed to {done.toString()}")
    return spark.read.schema(df.schema).parquet(done.toString())
