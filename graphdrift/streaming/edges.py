"""Edge-list files arriving over time: the same comment filter and parser as the batch
source, on a file stream, appended to a Parquet edge table with a checkpointed sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.edgelist import drop_comments, parse_edge_lines


def edge_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_edge_lines(drop_comments(r.load(path)))


def append_edges(stream: DataFrame, out_path: str, checkpoint_path: str, once: bool = True) -> StreamingQuery:
    w = stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint_path)
    w = w.outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
