"""Scratch tables of operators that work in several steps.

Every operator that needs an intermediate table writes it as Parquet below the
folder named by ``spark.checkpoint.dir``, or else the session's checkpoint folder
(all executors and the driver share it), which also cuts the lineage.  Only a
local session without either (tests) gets a temporary folder; a cluster without
one is refused.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_root: list[str] = []
_scopes = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a local session that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or None
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="entwine-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return _own_root[0]


class Scratch:
    """Parquet tables of one run of one operator, under a name of their own."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{operator}-{uuid.uuid4().hex}"
        for scope in getattr(_scopes, "open", ()):
            scope.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, name: str, df: DataFrame, compression: str = "snappy", last: bool = False, batch_bytes: int = 0) -> DataFrame:
        """Write ``df`` and return the written table (lineage ends there).

        With ``last`` the shuffle files end there too; Arrow batches are closed beyond ``batch_bytes``, if given.
        """
        own = ({_CLEANUP: "true"} if last else {}) | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
        held = {k: self.spark.conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", compression).parquet(self.path(name))
        finally:
            for k, v in held.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        self._delete(*(self.path(n) for n in names))

    def close(self) -> None:
        """Delete all tables; DataFrames that still read them are of no use afterwards."""
        self._delete(self.base)

    def _delete(self, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Delete the scratch tables of all operators called inside; their results must have been written by then."""
    stack = _scopes.open = getattr(_scopes, "open", [])
    held: list[Scratch] = []
    stack.append(held)
    try:
        yield
    finally:
        stack.pop()
        for scratch in held:
            scratch.close()
