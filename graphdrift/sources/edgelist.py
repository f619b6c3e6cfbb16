"""Edge-list text source: tab-separated lines, first two columns are ids, '#' lines are
comments; optional seeded sample of the lines before parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec

def drop_comments(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("value").startswith("#"))


def parse_edge_lines(lines: DataFrame) -> DataFrame:
    """(src, dst, weight) from a one-column ``value`` frame.  Extra columns are ignored,
    the weight is the constant 1.0; a malformed id fails the job (ANSI cast)."""
    parts = F.split(F.col("value"), "\t")
    return lines.select(parts.getItem(0).cast("long").alias("src"),
                        parts.getItem(1).cast("long").alias("dst"),
                        F.lit(1.0).alias("weight"))


def sample_lines(lines: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """Bernoulli sample without replacement: a line stays when the 48-bit hash of (seed, line) falls
    below ``fraction``.  The same lines stay on any cluster layout and on retry; repeated lines
    stay or go together."""
    return lines.filter(vec.unit_hash(F.lit(seed), F.col("value")) < F.lit(float(fraction)))


def read_edge_list(spark: SparkSession, path: str, fraction: float | None = None, seed: int = 1) -> DataFrame:
    lines = drop_comments(spark.read.text(path))
    if fraction is not None and fraction < 1.0:
        lines = sample_lines(lines, fraction, seed)
    return parse_edge_lines(lines)
