"""Edge-list source, sinks written and read back, the file-stream edge loader."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from graphdrift import job
from graphdrift.model import LayoutParams
from graphdrift.sinks import export
from graphdrift.sources import edgelist, fixtures
from graphdrift.streaming.edges import append_edges, edge_stream


def _lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_parse_comments_and_extra_columns(spark):
    lines = _lines(spark, ["# header", "1\t2", "3\t4\textra\tmore", "#5\t6"])
    e = edgelist.parse_edge_lines(edgelist.drop_comments(lines)).collect()
    assert [(r.src, r.dst, r.weight) for r in e] == [(1, 2, 1.0), (3, 4, 1.0)]


def test_bad_id_fails(spark):
    with pytest.raises(Exception):
        edgelist.parse_edge_lines(_lines(spark, ["1\tx"])).collect()


def test_read_and_sample(spark):
    d = tempfile.mkdtemp(prefix="gd-edges-")
    path = os.path.join(d, "edges.txt")
    with open(path, "w") as f:
        f.write("# comment\n" + "".join(f"{i}\t{i + 1}\n" for i in range(200)))
    full = edgelist.read_edge_list(spark, path)
    assert full.count() == 200
    part = edgelist.read_edge_list(spark, path, fraction=0.5, seed=1).count()
    assert 0 < part < 200
    lines = edgelist.drop_comments(spark.read.text(path))
    h1 = {r.value for r in edgelist.sample_lines(lines, 0.25, 3).collect()}
    assert h1 == {r.value for r in edgelist.sample_lines(lines.repartition(7), 0.25, 3).collect()} and 20 < len(h1) < 80
    assert h1 != {r.value for r in edgelist.sample_lines(lines, 0.25, 4).collect()}
    many = spark.range(1_000_000).select(F.col("id").cast("string").alias("value"))
    assert 60 < edgelist.sample_lines(many, 1e-4, 1).count() < 140


def test_job_from_edge_list_to_tables(spark):
    d = tempfile.mkdtemp(prefix="gd-job-")
    os.makedirs(os.path.join(d, "in"))
    with open(os.path.join(d, "in", "edges.txt"), "w") as f:
        f.write("# comment\n" + "".join(f"{i}\t{(i * 7) % 30}\n" for i in range(30)))
    back = job.run(spark, os.path.join(d, "in"), os.path.join(d, "out"),
                   LayoutParams(iterations=2, repulsion="neighbors"))
    nodes = back["nodes"].toPandas()
    assert len(nodes) == 30 and list(nodes.columns) == ["Id", "X", "Y", "dX", "dY", "k", "m", "c"]
    assert nodes.X.astype(float).abs().max() <= 5000 and nodes.k.astype(int).sum() == 60
    assert back["links"].count() == 30 and back["displacements"].count() == 30
    assert [int(r.n_edges) for r in back["report"].collect()] == [30, 30]


def test_sinks_roundtrip(spark):
    g = fixtures.house(spark)
    d = tempfile.mkdtemp(prefix="gd-sink-")
    nodes = export.with_prefix(export.node_table(g), "#")
    export.write_table(nodes, os.path.join(d, "nodes"))
    back = spark.read.option("header", True).option("sep", "\t").csv(os.path.join(d, "nodes"))
    assert back.columns == ["#Id", "X", "Y", "dX", "dY", "k", "m", "c"] and back.count() == 5
    edges = export.edge_table(g)
    export.write_table(edges, os.path.join(d, "edges"))
    eb = spark.read.option("header", True).option("sep", "\t").csv(os.path.join(d, "edges"))
    assert sorted((r.Source, r.Target) for r in eb.collect())[0] == ("a", "b")
    disp = export.displacement_table(g.vertices.select("id", "dx", "dy"), "rep", 1)
    export.write_table(disp, os.path.join(d, "disp"), fmt="parquet", partition_by=["label", "iteration"])
    assert spark.read.parquet(os.path.join(d, "disp")).filter(F.col("iteration") == 1).count() == 5
    lines = {r.line for r in export.inspect_links(g).collect()}
    assert "a linkTo( b )" in lines
    assert export.layout_links(g.edges).first().WEIGHT == 1.0
    assert export.layout_nodes(g.vertices).columns == ["label", "posX", "posY"]


def test_edge_stream(spark):
    src = tempfile.mkdtemp(prefix="gd-stream-in-")
    out = tempfile.mkdtemp(prefix="gd-stream-out-")
    ck = tempfile.mkdtemp(prefix="gd-stream-ck-")
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("# c\n1\t2\n2\t3\n")
    q = append_edges(edge_stream(spark, src), out, ck)
    q.awaitTermination(120)
    got = sorted((r.src, r.dst) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2), (2, 3)]
