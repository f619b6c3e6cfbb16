"""Session helpers: building a session for tests/bench and finding the checkpoint folder.

On a cluster the session comes from the caller; the library only reads
``spark.checkpoint.dir`` from it.  A folder is set here only when the session
has none.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "graphdrift") -> SparkSession:
    """Session for tests and the bench (local mode).  Cluster jobs pass their own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _scheme(spark: SparkSession, folder: str) -> str:
    """Scheme of the file system a folder is on (the default one if it names none)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()


def _same_on_every_executor(spark: SparkSession, folder: str) -> bool:
    """Whether a ``file:`` folder is one folder on all machines (a mounted share): the driver leaves a marker
    there, and tasks on the executors look for it."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/graphdrift-shared-{uuid.uuid4().hex}")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(marker)
    try:
        path = fs.makeQualified(marker).toUri().getPath()
        tasks = 4 * spark.sparkContext.defaultParallelism
        return all(spark.sparkContext.parallelize(range(tasks), tasks).map(lambda _: os.path.isdir(path)).collect())
    finally:
        fs.delete(marker, True)


#: (application, folder) of the ``file:`` folders that were found to be the same on every executor.
_SHARED: set[tuple[str, str]] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and work tables.

    Order: the SparkContext's folder, then ``spark.checkpoint.dir`` from the session.  When both are
    unset, a fresh temporary folder is made in local mode; a cluster takes a folder below its
    warehouse (so does ``local-cluster``, whose executors are processes of their own and need not see the
    driver's temporary folder).  On a cluster a folder named ``file:`` may be a share that all machines
    mount or a disk of each its own: once an application the executors look for what the driver wrote
    there, and it is an error if one does not see it.
    """
    sc = spark.sparkContext
    local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    folder = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="graphdrift-ckpt-") if local else \
            f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_graphdrift"
    if not local and (sc.applicationId, folder) not in _SHARED:
        if _scheme(spark, folder) == "file" and not _same_on_every_executor(spark, folder):
            raise ValueError(f"{CHECKPOINT_CONF} ({folder}) is on each machine's own disk; use a shared file system")
        _SHARED.add((sc.applicationId, folder))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
        _SHARED.add((sc.applicationId, sc.getCheckpointDir()))
    return sc.getCheckpointDir() or folder


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


FREE_SHUFFLES_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries run inside give up their shuffle files when they end, not when the driver happens to collect its
    garbage: what a work table was made from is on disk no longer than it takes to write it.  The setting is the
    caller's again afterwards."""
    was = spark.conf.get(FREE_SHUFFLES_CONF, None)
    spark.conf.set(FREE_SHUFFLES_CONF, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(FREE_SHUFFLES_CONF)
        else:
            spark.conf.set(FREE_SHUFFLES_CONF, was)


class Scratch:
    """Work tables of one run, as Parquet folders below the checkpoint folder.

    Like a checkpoint a work table cuts the lineage and survives a lost executor; unlike one it
    is columnar (later reads take only the columns they need), can be laid out by a partition
    column, and is deleted as soon as its run needs it no more.  Nothing enters the catalog.  The shuffle
    files of the query that fills it go once it is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = ensure_checkpoint_dir(spark).rstrip("/")
        self.folder = f"{root}/graphdrift-work/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        w = df.write if partition_by is None else df.write.partitionBy(partition_by)
        with shuffles_freed(self.spark):
            w.parquet(path)
        return self.spark.read.parquet(path) if partition_by else self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.folder)


def clear_work(spark: SparkSession) -> None:
    """Delete every work table this application has left (results of layouts included)."""
    _delete(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/graphdrift-work/{spark.sparkContext.applicationId}")
