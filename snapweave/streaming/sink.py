"""A folder of micro-batches that count once, however often each is tried."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommittedBatches:
    """Versioned outputs beside a manifest: data/<batch>-<attempt>/ and manifest/<batch>, which names the attempt that counts.

    A batch is written whole under a name of its own and then named in the manifest by one rename, which fails where the batch
    has an entry. A run that is killed between the two leaves an output that nothing names; when the stream starts again
    from its checkpoint, the batch is written anew. A batch that is tried again after its entry was made is left alone.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def is_committed(self, batch_id: int) -> bool:
        return self._files().exists(self._path(f"manifest/{batch_id:012d}"))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """For `foreachBatch`."""
        if self.is_committed(batch_id):
            return
        attempt = f"{batch_id:012d}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{attempt}")
        self.commit(batch_id, attempt)

    def commit(self, batch_id: int, attempt: str) -> None:
        files, entry, draft = self._files(), self._path(f"manifest/{batch_id:012d}"), self._path(f"drafts/{attempt}")
        out = files.create(draft, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        files.mkdirs(entry.getParent())
        if files.exists(entry) or not files.rename(draft, entry):
            files.delete(draft, False)

    def attempts(self) -> list[str]:
        """The outputs that count, a name for each batch, in order of the batches."""
        if not self._files().exists(self._path("manifest")):
            return []
        return sorted(r.value for r in self.spark.read.text(f"{self.root}/manifest").collect())

    def read(self, schema: str) -> DataFrame:
        """All rows of the batches that count, with `batch`."""
        found = [f"{self.root}/data/{x}" for x in self.attempts()]
        if not found:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        batch = F.regexp_extract(F.input_file_name(), r"/data/(\d{12})-", 1).cast("long")
        return self.spark.read.schema(schema).parquet(*found).withColumn("batch", batch)

    def latest(self, schema: str, keys: list[str]) -> DataFrame:
        """The last row of every key, for sinks of changed rows."""
        rows = self.read(schema)
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("top"))
        return top.select(*keys, "top.*")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, sink: CommittedBatches, mode: str, store: str | None = None) -> None:
    """Process what has come since the last run on this sink, and stop; progress is kept beside its batches.

    `store` names the provider of the state store for this run; keyed state of one's own needs `ROCKS`.
    """
    conf = sink.spark.conf
    before = conf.get(STORE, None)
    if store is not None:
        conf.set(STORE, store)
    try:
        writer = stream.writeStream.foreachBatch(sink.write).outputMode(mode).option("checkpointLocation", f"{sink.root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        if store is not None and before is None:
            conf.unset(STORE)
        elif store is not None:
            conf.set(STORE, before)
