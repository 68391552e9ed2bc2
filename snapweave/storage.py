"""Tables kept in the folder that driver and executors share; they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: For each `released` block that is open in this context, the folders made in it.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where that may be unset, a local folder of our own; elsewhere an unset one raises."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="snapweave-shared-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


class Scratch:
    """Numbered tables under one new folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._at: dict[int, tuple[DataFrame, str]] = {}
        self._made = 0
        for roots in _made.get():
            roots.append(self.root)

    def save(self, frame: DataFrame, label: str) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{self._made:03d}-{label}"
        frame.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        self._at[id(kept)] = (kept, path)
        return kept

    def drop(self, frame: DataFrame) -> None:
        """Delete a table that no later step reads."""
        _, path = self._at.pop(id(frame))
        _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def released(spark: SparkSession, kept: Scratch) -> Iterator[None]:
    """Deletes, at the end and after errors too, the tables of scratch folders made in this block, but for `kept`; frames that read them can't be used after.

    What other threads make meanwhile is theirs.
    """
    roots: list[str] = []
    token = _made.set((*_made.get(), roots))
    try:
        yield
    finally:
        _made.reset(token)
        for root in roots:
            if root != kept.root:
                _delete(spark, root)
