"""Helpers that the corpus operators share: shared storage, bounded broadcasts, skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a few fixed-width columns that may be broadcast, after they were counted.
BROADCAST_ROWS = 1_000_000
#: A key with more than one in this many rows is hot; so there are at most this many hot keys.
HOT_SHARE = 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. In local mode, where driver and executors are one process, one of our own if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"{tempfile.gettempdir()}/gridloom-checkpoints"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts lineage and survives lost executors.

    Results are lazy and read these tables, so they stay until discard(), or clean() for all of an application.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() has returned, when nothing reads it any more."""
    _delete(df.sparkSession, df._table)


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application; its lazy results cannot be read afterwards."""
    _delete(spark, _own_dir(spark))


def numbered(docs: DataFrame, name: str, **columns: Column) -> DataFrame:
    """A table of the columns, and `row`: numbers given once, so they are the same in all jobs however the scan of docs is dealt out."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in columns.items()]), name)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty. For texts of ASCII only, lower() does the same and is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df (materialized, narrow) was counted to be within the bound; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skew_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """left LEFT JOIN right on keys, where right has one row a key and size_col says how many left rows share it.

    Keys with over total/HOT_SHARE rows number under HOT_SHARE, so they are broadcast; the rest is shuffled.
    """
    bar = max(1000, total // HOT_SHARE)
    names = [c for c in right.columns if c not in keys]
    hot = F.broadcast(right.where(F.col(size_col) > bar).select(*keys, F.struct(*names).alias("__hot")))
    cold = right.where(F.col(size_col) <= bar).select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*names).alias("__cold"))
    both = left.join(hot, keys, "left")
    # Rows that met a hot key get a null key here and so do not gather in one task.
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20)).cast("int")
    both = both.withColumns({f"__c{i}": F.when(F.col("__hot").isNull(), F.col(k)) for i, k in enumerate(keys)} | {"__salt": F.when(F.col("__hot").isNotNull(), spread).otherwise(F.lit(-1))})
    cold = cold.withColumn("__csalt", F.lit(-1))
    on = [F.col(f"__c{i}") == F.col(f"__{k}") for i, k in enumerate(keys)] + [F.col("__salt") == F.col("__csalt")]
    joined = both.join(cold, on, "left")
    return joined.select(*left.columns, *[F.coalesce(F.col(f"__hot.{n}"), F.col(f"__cold.{n}")).alias(n) for n in names])
