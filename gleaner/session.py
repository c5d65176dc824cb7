"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library counts on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join side even when that costs one more shuffle above it.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gleaner-package-"), "gleaner.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as held:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    held.write(full, os.path.join("gleaner", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._gleaner_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    A temporary folder is used only where the session names none and driver and
    executors are one process, as in tests. Anywhere else an unnamed folder is an
    error: executors would write to their own disks.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share (master is {master})")
        named = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_WORK: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    for open_ in _WORK:
        open_.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession, keep: str) -> Iterator[None]:
    """Work whose tables are deleted at its end, but for those whose name begins with ``keep``.

    What stays must be stored: nothing that is read later may still need a deleted table.
    """
    made: list[str] = []
    _WORK.append(made)
    try:
        yield
    finally:
        _WORK[:] = [held for held in _WORK if held is not made]  # nested work may have made the same
        for path in made:
            if not path.rsplit("/", 1)[1].startswith(keep):
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores where the files give fewer splits than there are cores.

    Meant for few small files under costly text work; a table with enough splits
    is returned as it is and moves no row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def gathered(df: DataFrame, *folders: str) -> DataFrame:
    """Rows of one output folder brought together before a partitioned write.

    Without it every task opens a file in every folder. Adaptive execution splits
    a folder that is too large for one task and merges small ones.
    """
    return df.hint("rebalance", *[F.col(f) for f in folders])


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The written files outlive lost executors, unlike cached blocks.
    """
    path = fresh_path(df.sparkSession, name)
    if partition_by:
        gathered(df, *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
