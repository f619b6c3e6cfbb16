"""Physical-plan properties: pruned scans, hub links split at runtime, work tables removed."""

import contextlib
import io

from pyspark.sql import functions as F

from conftest import SMALL
from graphdrift.model import LayoutParams
from graphdrift.operators import layout, stats
from graphdrift.plans.queries import QUERIES
from graphdrift.session import ensure_checkpoint_dir
from graphdrift.sources import fixtures


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_columns_reach_the_scan(spark):
    text = plan(QUERIES["functional_layer"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double>" in text


def test_hub_links_are_split(spark):
    """A third of the links start at one vertex: the join to the vertices deals them to many tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 60_000
        e = spark.range(n, numPartitions=16).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("src"),
                                  (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
        v = spark.range(n).select("id", F.col("id").cast("double").alias("x"))
        j = e.join(v.withColumnRenamed("id", "src"), "src")
        sizes = j.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in sizes) == n
        assert max(r["count"] for r in sizes) < n / 4                  # the hub alone holds n / 3
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _tables(spark) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/graphdrift-work/{spark.sparkContext.applicationId}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.listStatus(p)) if fs.exists(p) else 0


def test_layout_leaves_only_its_result(spark):
    g = fixtures.house(spark)
    before = _tables(spark)
    layout.layout(g, LayoutParams(repulsion="neighbors", iterations=6))
    assert _tables(spark) - before == 2                      # the links and the last iteration
    before = _tables(spark)
    stats.label_propagation(g, 4)
    assert _tables(spark) - before == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("graphdrift")]
