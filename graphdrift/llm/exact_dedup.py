"""Exact deduplication by a stateful stream over a folder of Parquet documents.

The stream keeps one state entry per digest, for ever (no watermark, so nothing expires), in
RocksDB on the executors' disks with its changelog in the shared folder: the digest, how often it
was seen, and the stable identifier and content locator (file, row) of the row that stays.
Because the state is a streaming aggregation, copies are combined before the shuffle and a group
that holds a third of all rows reaches the state as a few partial rows.

Digest hits are then checked on full bytes: for every digest seen more than once the smallest and
the largest text are compared (again combined before the shuffle).  If they differ, the digest has
collided and its rows are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ascii_lower, staged, text_or_empty, work_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",      # many small stores
}


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = ascii_lower(text_or_empty(F.col(text_col)))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("_norm"),
                     F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.select("doc_id", "_norm", digest(F.col("_norm")).alias("_digest"), "_file", "_row")


def _needed(spark: SparkSession, source: str, id_col: str, text_col: str) -> StructType:
    """Schema of the id and the text alone: no other column, of whatever name, is in the way."""
    schema = spark.read.parquet(source).schema
    return StructType([f for f in schema.fields if f.name in (id_col, text_col)])


def _keeper() -> Column:
    """Largest doc_id stays (null is smallest); equal ids: the earliest file and row."""
    return F.max(F.struct(F.col("doc_id"), F.col("_file"), (-F.col("_row")).alias("_nrow")))


def run_state(spark: SparkSession, source: str, id_col: str = "doc_id", text_col: str = "text",
              digest: Callable[[Column], Column] = sha256_digest, checkpoint: str | None = None,
              max_bytes_per_trigger: int = 64 << 30, max_files_per_trigger: int | None = None) -> DataFrame:
    """Feed every file of ``source`` not yet seen by ``checkpoint`` to the state and return the
    state: _digest, keep (doc_id, _file, _nrow), group_size.  Called again with the same
    checkpoint it takes only the new files."""
    checkpoint = checkpoint or work_path(spark, "dedup-state")
    reader = spark.readStream.schema(_needed(spark, source, id_col, text_col))
    reader = (reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger
              else reader.option("maxBytesPerTrigger", max_bytes_per_trigger))
    # as a pattern, so that the path may be one file as well as a folder
    pattern = f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"
    seen = (_rows(reader.parquet(pattern), id_col, text_col, digest)
            .groupBy("_digest").agg(_keeper().alias("keep"), F.count(F.lit(1)).alias("group_size")))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        query = (seen.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", checkpoint).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        value = state.schema["value"].dataType.names
        return staged(state.select(F.col("key._digest").alias("_digest"), F.col("value")[value[0]].alias("keep"),
                                   F.col("value")[value[1]].alias("group_size")), "dedup-index")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(spark: SparkSession, source: str, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256_digest, **stream) -> DataFrame:
    """One row per document of ``source``: doc_id, keep_id, group_size, kept, text_sha256, and the
    row's locator (_file, _row).

    Texts are equal when identical after lower-casing A-Z; a null text is empty; of equal texts the
    largest doc_id stays (null ids last), of equal ids the first file and row, so exactly one row
    of each group is kept.  An empty table gives no rows; other columns are not read.
    """
    index = run_state(spark, source, id_col, text_col, digest, **stream)
    rows = _rows(spark.read.schema(_needed(spark, source, id_col, text_col)).parquet(source), id_col, text_col, digest)
    hits = index.filter("group_size > 1").select("_digest")
    collided = staged(rows.select("_digest", "_norm").join(hits, "_digest", "left_semi")
                      .groupBy("_digest").agg(F.min("_norm").alias("lo"), F.max("_norm").alias("hi"))
                      .filter("lo <> hi").select("_digest"), "dedup-collided")
    narrow = rows.select("doc_id", "_digest", "_file", "_row", F.sha2(F.col("_norm"), 256).alias("text_sha256"))
    if collided.isEmpty():
        found = narrow.join(index, "_digest")
    else:
        apart = rows.join(collided, "_digest", "left_semi")
        by_text = apart.groupBy("_digest", "_norm").agg(_keeper().alias("keep"), F.count(F.lit(1)).alias("group_size"))
        apart = (apart.join(by_text, ["_digest", "_norm"])
                 .withColumn("text_sha256", F.sha2(F.col("_norm"), 256)).drop("_norm"))
        found = narrow.join(collided, "_digest", "left_anti").join(index, "_digest").unionByName(apart)
    kept = ((F.col("_file") == F.col("keep._file")) & (F.col("_row") == -F.col("keep._nrow")))
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long"),
                        kept.alias("kept"), "text_sha256", "_file", "_row")


def kept_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that exact deduplication drops, all columns as they were."""
    path = work_path(spark, "dedup-source")
    # by place: whatever the columns are called, no name is in the way of a file's row numbers
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    plain.write.option("compression", "zstd").parquet(path)
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    # a table of the rows that go: its size is known before the join, so texts are shuffled only if it is large
    gone = staged(exact_dedup(spark, path, at[id_col], at[text_col]).filter(~F.col("kept")).select("_file", "_row"),
                  "dedup-gone")
    rows = spark.read.schema(plain.schema).parquet(path)
    here = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return here.join(gone, ["_file", "_row"], "left_anti").select(*names).toDF(*docs.columns)
