"""Graphs derived from the order/supply tables.

* ``trade``: nations; link supplier nation -> customer nation, weight = number of line items.
* ``trade_functional``: same vertices; weight = revenue of all orders, scaled to max 1.
* ``supply``: parts (id 2*key) and suppliers (id 2*key+1); link part -> supplier,
  weight = total quantity.
* ``market``: customers (3*key), parts (3*key+1) and suppliers (3*key+2); every line item links its three
  to each other, weight = line items.
* ``geo``: regions (3*key), nations (3*key+1), customers (3*key+2); tree links.

All joins are equi-joins on keys; line items are pre-aggregated per order before the
order side is joined, so the big shuffle carries one row per (order, nation) instead of
one per line item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators.build import start_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _positioned(v: DataFrame, width: float, height: float, seed: int, bounds: str = "center") -> DataFrame:
    x, y = start_position(F.col("id"), width, height, seed, bounds)
    return v.select("id", "label", x.alias("x"), y.alias("y"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))


def nation_vertices(spark, sf_dir, width=10000.0, height=10000.0, seed=0, bounds="center") -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"),
                                              F.col("n_name").alias("label"))
    return _positioned(n, width, height, seed, bounds)


def _order_nation(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey")


def _lineitem_nation(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(s, li.l_suppkey == s.s_suppkey).groupBy("l_orderkey", "s_nationkey").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("l_extendedprice").alias("revenue"))


def trade_edges(spark, sf_dir) -> DataFrame:
    j = _lineitem_nation(spark, sf_dir).join(_order_nation(spark, sf_dir),
                                              F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("s_nationkey", "c_nationkey").agg(F.sum("n_items").alias("w")).select(
        F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"),
        F.col("w").cast("double").alias("weight"))


def trade_functional_edges(spark, sf_dir) -> DataFrame:
    j = _lineitem_nation(spark, sf_dir).join(_order_nation(spark, sf_dir),
                                              F.col("l_orderkey") == F.col("o_orderkey"))
    e = j.groupBy("s_nationkey", "c_nationkey").agg(F.sum("revenue").alias("w"))
    top = e.select(F.max("w")).scalar()
    return e.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"),
                    (F.col("w") / top).alias("weight"))


def trade(spark, sf_dir, width=10000.0, height=10000.0, seed=0, bounds="center") -> Graph:
    return Graph(nation_vertices(spark, sf_dir, width, height, seed, bounds), trade_edges(spark, sf_dir))


def trade_functional(spark, sf_dir, width=10000.0, height=10000.0, seed=0) -> Graph:
    return Graph(nation_vertices(spark, sf_dir, width, height, seed), trade_functional_edges(spark, sf_dir))


def supply_vertices(spark, sf_dir, width=10000.0, height=10000.0, seed=0) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id"),
                                            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("label"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_name").alias("label"))
    return _positioned(p.unionByName(s), width, height, seed)


def supply_edges(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("w")).select(
        (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"),
        F.col("w").cast("double").alias("weight"))


def supply(spark, sf_dir, width=10000.0, height=10000.0, seed=0) -> Graph:
    return Graph(supply_vertices(spark, sf_dir, width, height, seed), supply_edges(spark, sf_dir))


def market_edges(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("o_custkey") * 3).cast("long").alias("c"), (F.col("l_partkey") * 3 + 1).cast("long").alias("p"),
        (F.col("l_suppkey") * 3 + 2).cast("long").alias("s"))
    ends = F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("c", "p"), ("p", "s"), ("s", "c"))]))
    return j.select(ends.alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def market(spark, sf_dir, width=10000.0, height=10000.0, seed=0) -> Graph:
    named = lambda t, key, at, tag: table(spark, sf_dir, t).select(
        (F.col(key) * 3 + at).cast("long").alias("id"), F.concat(F.lit(tag), F.col(key).cast("string")).alias("label"))
    v = named("customer", "c_custkey", 0, "C").unionByName(named("part", "p_partkey", 1, "P")).unionByName(
        named("supplier", "s_suppkey", 2, "S"))
    return Graph(_positioned(v, width, height, seed), market_edges(spark, sf_dir))


def geo_vertices(spark, sf_dir, with_regions: bool = True, width=10000.0, height=10000.0, seed=0) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 3 + 1).alias("id"),
                                              F.col("n_name").alias("label"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3 + 2).alias("id"), F.col("c_name").alias("label"))
    v = n.unionByName(c)
    if with_regions:
        r = table(spark, sf_dir, "region").select((F.col("r_regionkey").cast("long") * 3).alias("id"),
                                                  F.col("r_name").alias("label"))
        v = r.unionByName(v)
    return _positioned(v, width, height, seed)


def geo_edges(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey").cast("long") * 3 + 1).alias("src"), (F.col("n_regionkey").cast("long") * 3).alias("dst"))
    c = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 3 + 2).alias("src"), (F.col("c_nationkey").cast("long") * 3 + 1).alias("dst"))
    return n.unionByName(c).select("src", "dst", F.lit(1.0).alias("weight"))


def geo(spark, sf_dir, with_regions: bool = True) -> Graph:
    return Graph(geo_vertices(spark, sf_dir, with_regions), geo_edges(spark, sf_dir))


def edge_lines(spark, sf_dir, with_comments: bool = True) -> DataFrame:
    """Edge-list text built from line items (part, supplier, quantity), plus one '#' line
    for every order when ``with_comments``."""
    li = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("\t", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("l_quantity").cast("string")).alias("value"))
    if not with_comments:
        return li
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("# order "), F.col("o_orderkey").cast("string")).alias("value"))
    return li.unionByName(o)
