"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under ``spark.checkpoint.dir`` that nothing else has. Only a local session without that setting gets one on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: With this setting Spark removes the shuffle files of a statement when the statement ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for a while; then what was there before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``, in folders ``by`` a column: its lineage and its plan end there.

    Plans that use one result many times stay small, and a lost executor costs no recomputation. Shuffle files of the
    write are of no use once the table stands, so they go with its end, not when the driver's memory is next tidied up.
    """
    path = new_folder(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    with setting(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """As ``stored``, as a table in buckets by ``key`` and sorted by it in each: what reads it and groups, ranks or joins by ``key``,
    or by ``key`` and more, shuffles nothing. As many buckets as shuffles have partitions; best after a step that is dealt by ``key``."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    return spark.read.table(name)


def sized(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, a stored table, marked for broadcast if it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: The column of the folders that the postings of an index lie in, and how many there are.
BUCKET = "bucket"
BUCKETS = 32


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def of_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The folders of ``df``, if it lies in buckets, that may hold one of the wanted keys; the buckets' numbers are few."""
    if BUCKET not in df.columns:
        return df
    buckets = [r[0] for r in wanted.select(bucket_of(F.col(key))).distinct().collect()]
    return df.filter(F.col(BUCKET).isin(buckets)).drop(BUCKET)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to as many tasks as shuffles have, however small it is: what it meets next makes many rows of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def in_buckets(df: DataFrame, key: str, spread: str) -> DataFrame:
    """``df`` with its bucket, dealt by bucket and by parts of ``spread``, so that a hot key's rows go to several tasks, and sorted by key."""
    rows = df.withColumn(BUCKET, bucket_of(F.col(key)))
    return rows.repartition(F.col(BUCKET), F.pmod(F.xxhash64(spread), F.lit(SPREAD))).sortWithinPartitions(BUCKET, key)


#: Parts that the rows of one key are dealt to at most.
SPREAD = 64


def by_key(df: DataFrame, key: str, spread: str | None = None) -> DataFrame:
    """``df`` dealt by ``key`` and sorted by it in each partition, so that a reader of few keys skips most row groups.

    With ``spread``, another column, the rows of a key that very many rows have go to several partitions.
    """
    salt = [F.pmod(F.xxhash64(spread), F.lit(SPREAD))] if spread else []
    return df.repartition(F.col(key), *salt).sortWithinPartitions(key)
