"""Session set-up, shared scratch tables and Arrow helpers for the operators.

Intermediate results that are read more than once are written as Parquet below
the folder that ``spark.checkpoint.dir`` names, which every executor reaches, so
a lost executor costs a re-read and not the job.  No operator keeps anything in
a machine-local folder on a cluster.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ship

#: Rows and bytes of one Arrow batch; bounds what a Python worker holds at once.
BATCH_ROWS = 2048
BATCH_BYTES = 4 << 20
#: Up to so many rows of keys (some 24 bytes each) are broadcast.
BROADCAST_KEYS = 1_000_000

ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

Batches = Iterator[pa.RecordBatch]

#: What a Python worker keeps from task to task: one operator's at a time.
_KEPT: dict[tuple, Any] = {}


def kept(make: Callable, *args) -> Any:
    """``make(*args)``, made once in a worker until other work comes to it."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _KEPT:
        released()
        _KEPT[key] = make(*args)
    return _KEPT[key]


def released() -> None:
    """Gives back what earlier stages' tasks left in this worker: workers live as long as the executor, within its memory."""
    if not _KEPT:
        return
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tuned(spark: SparkSession) -> SparkSession:
    """Sets the batch limits that the operators' memory bounds assume, and sends the package to the executors."""
    ship(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where it is unset and all executors are in one process (as in tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that one run of an operator writes and reads again.

    ``keep`` writes a DataFrame and returns it as read back, ``drop`` deletes
    tables by name once later ones have replaced them.  Whatever is left goes
    when the application ends, or stays for the cluster's own clean-up of the
    shared folder if the driver dies.
    """

    def __init__(self, spark: SparkSession, kind: str):
        self.spark = tuned(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/scriptorium/{kind}-{uuid.uuid4().hex}"
        self.names: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        self.names[name] = self.path(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.names.pop(name, None):
                _delete(self.spark, path)

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Keeps ``df`` and deletes every other table of the run."""
        out = self.keep(df, name)
        self.drop(*[n for n in self.names if n != name])
        return out

    def until_exit(self, df: DataFrame) -> DataFrame:
        """Deletes what is left when the application ends: frames derived from ``df`` read it as long."""
        atexit.register(quietly_delete, self.spark, self.root)
        return df


def quietly_delete(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session is gone; the folder is the cluster's to clean
        pass


def few(keys: DataFrame) -> DataFrame:
    """Rows of a few numbers, broadcast if there are no more than ``BROADCAST_KEYS`` of them."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
