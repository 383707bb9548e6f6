"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Drops the shuffle files of a statement when it ends, instead of when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: dict[str, str] = {}
_scope: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime SQL settings every operator relies on: UTC instants, AQE, compiled code.

    The JVM leaves methods above 8000 bytes of bytecode uncompiled, so wider generated
    stages fall back to split projections instead.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder. A cluster session without it falls back to
    the warehouse if that is a shared store, and is refused if it is a local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        app = spark.sparkContext.applicationId
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="sensorloom-")
        return _local_scratch[app]
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_sensorloom_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scope.get() or scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Keep the intermediate tables made inside in one folder and drop it at the end.

    Results that still read from them must be written before the scope ends.
    """
    folder = f"{scratch_root(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and lets each later reader prune the
    columns it does not need. Zstandard keeps ids and repeated text a third smaller at
    the same speed. The write's shuffle files go when it has ended: only it reads them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make()``, written as ``materialize`` does; the tables that it makes on its way go then."""
    outer = _scope.get()
    with scratch_scope(spark):
        df = make()
        token = _scope.set(outer)
        try:
            return materialize(df, label)
        finally:
            _scope.reset(token)


def default_slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
