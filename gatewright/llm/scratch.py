"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own, but only in local mode: on a cluster no folder of this machine is shared."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/gatewright"


def let_workers_import(spark: SparkSession) -> None:
    """In local modes, workers share the driver's files: tell them where this package lies. On a cluster it is shipped as usual, e.g. with --py-files."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(":") if p]
        if root not in paths:
            sc.environment["PYTHONPATH"] = ":".join([root, *paths])


_TRACKED: contextvars.ContextVar[list["Scratch"] | None] = contextvars.ContextVar("tracked", default=None)


@contextlib.contextmanager
def tracked() -> Iterator[list["Scratch"]]:
    """Collects the scratch folders of all operator calls within; the caller may drop them once their results are written."""
    held: list[Scratch] = []
    token = _TRACKED.set(held)
    try:
        yield held
    finally:
        _TRACKED.reset(token)


class Scratch:
    """Tables of one operator call. Each is written once and read back, which cuts lineage and survives lost executors. They go when the session ends, or by drop_all()."""

    def __init__(self, spark: SparkSession, what: str):
        let_workers_import(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        if (held := _TRACKED.get()) is not None:
            held.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a reader of the written table. Spark drops the shuffle files of this one execution at its end."""
        at = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            with contextlib.suppress(Exception):
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)

    def drop_all(self) -> None:
        """Delete every table, once nothing that was returned is read any more."""
        with contextlib.suppress(Exception):
            self._fs.delete(self._path, True)
