"""Small things the operators share: the word pattern, table access and lineage cuts."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009..U+000D (same as bytes.split() over UTF-8).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null gives an empty array. Splitting costs half of extracting."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of the warehouse only where the cluster names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quire_shared"


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage the way checkpoint() does, but keeps columns prunable, and survives lost executors
    because no part of it lives in executor memory or on executor-local disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more, and let Spark drop the shuffle files of the
    plans that are gone, which it does when the driver's garbage is collected."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    jvm.java.lang.System.gc()


def with_rows(df: DataFrame, label: str) -> DataFrame:
    """df with a key of each row in _row, written so that it stays the same: ids may be null or recur."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), label)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m (null id: crc32 of the empty text, which is 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m
