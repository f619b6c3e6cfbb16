"""The shared folder on a cluster: a mounted share counts, a disk of each machine's own does not."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from graphdrift import session
from graphdrift.model import LayoutParams
from graphdrift.operators import coarsen, forces, layers, layout, messages, stats
from graphdrift.sinks import export
from graphdrift.sources import fixtures


class _Cluster:
    """The test session as if its master were a cluster's."""

    def __init__(self, spark, folder, app=None, warehouse=None, master="spark://host:7077"):
        self._spark, self._folder, self._warehouse = spark, folder, warehouse
        self.master, self.applicationId = master, app or uuid.uuid4().hex
        self.set: list[str] = []

    sparkContext = conf = property(lambda self: self)

    def getCheckpointDir(self):
        return self.set[-1] if self.set else self._folder

    def setCheckpointDir(self, folder):
        self.set.append(folder)

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self._warehouse if key == "spark.sql.warehouse.dir" else default

    def __getattr__(self, name):
        return getattr(self._spark.sparkContext, name)


def test_a_mounted_share_is_taken_on_a_cluster(spark, tmp_path):
    folder = f"file://{tmp_path}/shared"
    assert session.ensure_checkpoint_dir(_Cluster(spark, folder)) == folder
    assert os.listdir(tmp_path / "shared") == []                 # the marker is gone


def test_the_executors_are_asked_once_an_application(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(session, "_same_on_every_executor", lambda *a: not asked.append(a))
    cluster = _Cluster(spark, f"file://{tmp_path}/shared")
    for _ in range(3):
        session.ensure_checkpoint_dir(cluster)
    assert len(asked) == 1


def test_a_cluster_without_a_folder_uses_its_warehouse(spark, tmp_path):
    cluster = _Cluster(spark, None, warehouse=f"file://{tmp_path}/warehouse")
    assert session.ensure_checkpoint_dir(cluster) == f"file://{tmp_path}/warehouse/_graphdrift"


def test_executors_in_processes_of_their_own_do_not_get_the_drivers_temporary_folder(spark, tmp_path):
    cluster = _Cluster(spark, None, warehouse=f"file://{tmp_path}/warehouse", master="local-cluster[3,4,1024]")
    assert session.ensure_checkpoint_dir(cluster) == f"file://{tmp_path}/warehouse/_graphdrift"


def test_a_disk_of_each_machines_own_is_still_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_same_on_every_executor", lambda *a: False)
    with pytest.raises(ValueError, match="own disk"):
        session.ensure_checkpoint_dir(_Cluster(spark, f"file://{tmp_path}/own"))


WORK_TABLES = {
    "triangles": stats.clustering_coefficient,
    "clusters": coarsen.clusters,
    "components": lambda g: messages.components(g).vertices,
    "force_total": lambda g: forces.force_total(g, 100.0, LayoutParams()),
    "layout": lambda g: layout.layout(g, LayoutParams(iterations=1)).graph.vertices,
    "layout_of_neighbors": lambda g: layout.layout(g, LayoutParams(iterations=1, repulsion="neighbors")).graph.vertices,
    "ranks": lambda g: layers.distance_strength_rank_corr(g.vertices, g.edges),
    "node_table": lambda g: export.node_table(g, lp_rounds=1),
}


def _rows(df):
    """Rows in order, doubles to 6 decimals (the last digits of a sum depend on the order of its terms)."""
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("name", WORK_TABLES)
def test_what_writes_work_tables_runs_on_a_cluster_with_a_mounted_share(spark, monkeypatch, name):
    """As on a cluster whose checkpoint folder is a ``file:`` share: the same rows as in local mode."""
    g = fixtures.house(spark)
    local = _rows(WORK_TABLES[name](g))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_SHARED", set())
    assert _rows(WORK_TABLES[name](g)) == local
    assert session._SHARED


def test_a_written_work_table_keeps_no_shuffle_files(spark):
    """What the query that fills it shuffled is off the disk soon after, though the frame is still held."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size()))
                     if f.startswith("shuffle_")}
    before, was = files(), spark.conf.get(session.FREE_SHUFFLES_CONF, None)
    work = session.Scratch(spark)
    held = spark.range(20_000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).repartition(3, "id"), F.col("k") == F.col("id"))
    table = work.table(held, "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == held.count() == 7
    assert spark.conf.get(session.FREE_SHUFFLES_CONF, None) == was
    work.drop()
