"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import warnings

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "kinpanel", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: spark-submit names the first, and AQE
    coalesces down from the cluster's own setting of the second.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a skewed join side even where that costs the next operator a shuffle
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # recording the call site of every column expression makes building large plans slow
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, which need it where it is not installed."""
    source = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kinpanel-package-")
    packed = shutil.make_archive(f"{folder}/kinpanel", "zip", os.path.dirname(source), os.path.basename(source))
    spark.sparkContext.addPyFile(packed)
    atexit.register(shutil.rmtree, folder, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.master.startswith("local") and (named.startswith("file:") or "://" not in named):
            warnings.warn(f"spark.checkpoint.dir is {named}: it must be a mount that the driver and all executors share", stacklevel=2)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="kinpanel-")
    spark.conf.set("spark.checkpoint.dir", made)
    atexit.register(shutil.rmtree, made, True)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/kinpanel-{label}-{uuid.uuid4().hex}"


_STAGES: list[str] = []


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def remove_stages(spark: SparkSession) -> int:
    """Delete the stage tables written so far by this process; call it when no result that reads them is needed."""
    return _delete(spark, _STAGES)


@contextmanager
def own_stages(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the stage tables written in it: whatever reads them must be consumed in the block."""
    before = list(_STAGES)
    try:
        yield
    finally:
        made = [p for p in _STAGES if p not in before]
        _STAGES[:] = [p for p in _STAGES if p in before]
        _delete(spark, made)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared folder now and return the table.

    Lineage is cut as with a reliable checkpoint, and the copy survives lost executors. Unlike a checkpoint, the table is
    columnar, so later steps read only their columns, and its size is known, so small results are broadcast by size.
    """
    path = scratch_path(df.sparkSession, "stage")
    _STAGES.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed_with(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``checkpointed``, and aggregates of the rows that are observed while they are written, without a pass of their own.

    A task that runs twice may be observed twice, so ask for a least or greatest value, or allow a count to be too high.
    """
    seen = Observation()
    table = checkpointed(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]))
    return table, seen.get
