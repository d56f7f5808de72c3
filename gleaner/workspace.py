"""Tables that cut lineage, kept in the folder that every node of the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python in batches of at most this size, so that long texts don't fill an executor; a smaller setting stays.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master may do without one: it then gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries run inside are removed as soon as each has ended."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


_open: ContextVar[list[Workspace] | None] = ContextVar("gleaner_workspaces", default=None)


@contextmanager
def scope():
    """Workspaces opened inside are closed at the end, when what was made from them has been read or written:

        with scope():
            dedup_lines(docs).write.parquet(path)
    """
    mine: list[Workspace] = []
    token = _open.set(mine)
    try:
        yield
    finally:
        _open.reset(token)
        for work in reversed(mine):
            work.close()


class Workspace:
    """One operator call's folder: ``stash`` writes a table and reads it back, ``discard`` drops one early.

    ``broadcast`` values live until ``release``, which destroys them all. Tables that a returned DataFrame still reads
    stay until ``close``, the end of the ``scope`` around the call, or until the folder named in spark.checkpoint.dir is cleared.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
        if not 0 < now <= BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        self.path = f"{shared_root(spark)}/gleaner/{label}-{uuid.uuid4().hex}"
        self._sent: list = []
        inside = _open.get()
        if inside is not None:
            inside.append(self)

    def stash(self, df: DataFrame, name: str, **measures):
        """The table as written; with ``measures`` (name to aggregate) also their values, taken while writing."""
        from pyspark.sql import Observation

        path = f"{self.path}/{name}"
        seen = Observation() if measures else None
        out = df.observe(seen, *(m.alias(n) for n, m in measures.items())) if seen else df
        with shuffles_removed(self.spark):
            out.write.mode("overwrite").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        return (back, seen.get) if seen else back

    def broadcast(self, value):
        sent = self.spark.sparkContext.broadcast(value)
        self._sent.append(sent)
        return sent

    def release(self) -> None:
        """Destroy the broadcasts, and let the JVM's cleaner find what ended queries held."""
        for sent in self._sent:
            sent.destroy()
        self._sent = []
        self.spark.sparkContext._jvm.System.gc()

    def discard(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        self.release()
        self._delete(self.path)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
