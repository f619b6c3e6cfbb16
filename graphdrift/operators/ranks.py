"""Global ranks and rank dependence, without a window over all rows.

Equal values are counted first, so a value that a third of the rows share is one row from there on.  The distinct
values are range-partitioned and written once; a partition's running count plus the rows of the partitions
before it (one number per partition reaches the driver) is the rank.  Ties share the mean of their places.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def _usable(c: str):
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def average_ranks(df: DataFrame, column: str, work: Scratch) -> DataFrame:
    """(column, n, rank) per distinct value: how many rows hold it and the mean of their places, from 1 for the
    smallest.  Null and NaN have no rank."""
    spark = df.sparkSession
    counts = df.filter(_usable(column)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranged = work.table(counts.repartitionByRange(column).select(column, "n", F.spark_partition_id().alias("part")), "ranged")
    totals = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = spark.createDataFrame([(p, t - n) for (p, n), t in zip(totals, accumulate(n for _, n in totals))],
                                   "part int, before long")
    running = F.sum("n").over(Window.partitionBy("part").orderBy(column))
    return ranged.select(column, "n", "part", running.alias("upto")).join(before, "part").select(
        column, "n", (F.col("before") + F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))


def with_ranks(df: DataFrame, columns: list[str], work: Scratch) -> DataFrame:
    """The rows that hold a value in every one of the columns, each with the rank ``<column>_rank`` among those rows."""
    for c in columns:
        df = df.filter(_usable(c))
    out = df
    for c in columns:
        out = out.join(average_ranks(df, c, work).select(c, F.col("rank").alias(f"{c}_rank")), c)
    return out.select(*df.columns, *[f"{c}_rank" for c in columns])


def rank_correlation(df: DataFrame, a: str, b: str, work: Scratch) -> DataFrame:
    """One row (n, rank_corr): the correlation of the ranks of two columns, null if either holds one value only.
    Rows equal in both are counted before the ranks are joined."""
    ranked = with_ranks(df.select(a, b), [a, b], work)
    pairs = ranked.groupBy(F.col(f"{a}_rank").alias("ra"), F.col(f"{b}_rank").alias("rb")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.select(F.sum("n")).scalar()
    middle = (total + F.lit(1)) / F.lit(2.0)
    da, db, n = F.col("ra") - middle, F.col("rb") - middle, F.col("n")
    s = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(n * da * db).alias("ab"),
                  F.sum(n * da * da).alias("aa"), F.sum(n * db * db).alias("bb"))
    varied = (F.col("aa") > 0) & (F.col("bb") > 0)
    return s.select(F.col("n").cast("long").alias("n"),
                    F.when(varied, F.col("ab") / F.sqrt(F.when(varied, F.col("aa") * F.col("bb")))).alias("rank_corr"))
