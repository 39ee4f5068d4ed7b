"""Session defaults. A cluster's own settings always win over these."""

from __future__ import annotations

import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkConf, cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans; safe to apply to a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_OPEN = threading.local()


def local_session(app: str = "riskloom", cores: str = "8", memory: str = "20g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    if not SparkConf().get("spark.checkpoint.dir", None):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="riskloom-", dir="/tmp"))  # one machine only
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package()
    return spark


def ship_package() -> None:
    """Send this package's functions to Python workers by value: they need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules["riskloom"])


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the engine relies on to a given session and ship the package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package()
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as named in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate. All of an application lie in one folder, which ``release`` removes."""
    path = f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Intermediates that this thread writes inside are removed at the end: what reads them must have been stored by then."""
    outer, _OPEN.paths = getattr(_OPEN, "paths", None), []
    try:
        yield
    finally:
        paths, _OPEN.paths = _OPEN.paths, outer
        for path in paths:
            _remove(spark, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str = "stage") -> DataFrame:
    """``materialise`` of what ``build`` gives, without the intermediates on the way to it."""
    path = scratch_path(spark, label)
    with passing(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove this application's intermediates. Results that still read them must have been stored before."""
    _remove(spark, _scratch_root(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/riskloom-{spark.sparkContext.applicationId}"
