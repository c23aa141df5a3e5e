"""Where intermediate tables are kept so that a lost executor cannot change them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The session's ``spark.checkpoint.dir`` decides. Only a local session, where
    driver and executors are one process, gets a folder of its own when the
    setting is missing; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vigilday-"))
        return context.getCheckpointDir()
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from that table.

    Used where a result is read several times, or must not be recomputed
    differently. Written columns can be read one by one, and Spark knows the
    table's size. A frame that is such a table already is returned as it is.
    """
    if getattr(df, "_is_stored", False):
        return df
    return _write(df, df)


def _write(df: DataFrame, watched: DataFrame) -> DataFrame:
    path = new_table_path(df.sparkSession, "stored")
    watched.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy._is_stored = True
    return copy


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """:func:`stored` with its number of rows and about their bytes in memory, observed while it is written."""
    def size(field: T.StructField):
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0)) + 16
        return F.lit(8)

    row = sum((size(f) for f in df.schema.fields), F.lit(0)).cast("long")
    metrics = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")]
    if getattr(df, "_is_stored", False):
        if not hasattr(df, "_size"):
            df._size = tuple(df.agg(*metrics).first())
        return df, *df._size
    seen = Observation()
    copy = _write(df, df.observe(seen, *metrics))
    copy._size = (seen.get["rows"], seen.get["bytes"])
    return copy, *copy._size


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this application, under the shared folder."""
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables this application has stored. Call it when its results are written."""
    folder = _app_dir(spark)
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(hadoop).delete(path, True)
