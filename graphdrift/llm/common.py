"""Helpers shared by the corpus operators: work tables in the shared folder, row keys, hashing."""

from __future__ import annotations

import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

NO_ID = (1 << 63) - 1        # a null id counts as the largest id
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_dir(spark: SparkSession) -> str:
    """Folder of this application's work tables below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-work/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, and
    every executor can read it again after a loss."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Delete this application's work tables.  Call it once the results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only.  On pure ASCII the built-in ``lower`` is the same and much faster."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _d, _k, text): ``_d`` is the id with null as the largest, ``_k`` a hash of the
    row.  Rows alike in both id and text share a key and get the same answer."""
    t = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"),
                       F.xxhash64(F.col(id_col), t).alias("_k"), text_or_empty(t).alias("text"))


def compressed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, _d, _k, text) with the text as zstd-compressed UTF-8 in ``z``: joins by key move
    the text in a third of its size."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [squeeze.compress(t.encode("utf-8", "replace")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], ["doc_id", "_d", "_k", "z"])

    return rows.select("doc_id", "_d", "_k", "text").mapInArrow(run, "doc_id long, _d long, _k long, z binary")


def plain(z: bytes) -> bytes:
    return zstandard.decompress(z)


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
