"""What the operators of this package share: tables, scratch space and word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator's contract: space and U+0009 to U+000D.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, if no lower bound is set: a batch of long texts has few rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it if ``df`` has a column so called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of this machine.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``: lineage ends there, and a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table is broadcast; a larger one is joined by a shuffle.
FEW = 500_000


def few(df: DataFrame, most: int = FEW) -> bool:
    return df.limit(most + 1).count() <= most


def sized(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if it is small."""
    return F.broadcast(df) if few(df) else df


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
