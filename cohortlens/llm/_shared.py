"""Places that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Groups with more than this share of all rows are joined by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE, LEAST_HOT = 1e-4, 500


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset a local session, as in tests, gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        base = context.getCheckpointDir().get()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def matched(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined with their group, of which groups has one row by keys; n is how many rows a group has.

    how is inner or left.  Groups that hold much of all rows are broadcast, and their rows stay where they are; the others are shuffled.
    rows is read twice if there are such groups, so it should be a table.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    limit = max(LEAST_HOT, int(total * HOT_SHARE))
    hot = groups.where(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(groups, keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(n) <= limit), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def own_name(wanted: str, columns: list[str]) -> str:
    """A column name that none of columns has, in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def filesystem(path: str):
    """A pyarrow file system and the path in it, for a URI as Hadoop writes it or a plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)
