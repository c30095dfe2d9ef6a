"""Snapshots as a stream: landed batches are reconciled, one after another, into a state kept as a table of versions.

State is written beside its predecessor and pointed to by the last version that finished, so a batch that is run
again after a failure gives the same version and nothing is read and overwritten at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.staging import staged
from ..operators.state import reconcile


class VersionedState:
    def __init__(self, spark: SparkSession, path: str, state_schema: str, runs_schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {"state": state_schema, "runs": runs_schema}

    def _files(self):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = jvm_path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return fs, jvm_path

    def last(self) -> int:
        """The last version both of whose tables were written whole; -1 before the first."""
        fs, jvm_path = self._files()
        if not fs.exists(jvm_path(self.path)):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(jvm_path(self.path))]
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and all(fs.exists(jvm_path(f"{self.path}/{n}/{t}/_SUCCESS")) for t in self.schemas)]
        return max(done, default=-1)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.last() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.path}/v{version}/{table}")

    def write(self, version: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")


def reconcile_batch(store: VersionedState, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch: rows of any number of companies with their batch columns (run_id, fetch_complete,
    parse_error_count, total_raw_records, observed_at). Batches of one company are applied in order of observed_at."""
    version = min(store.last(), batch_id - 1)
    state, runs = store.read("state", version), store.read("runs", version)
    times = [r[0] for r in batch.select("observed_at").where("observed_at IS NOT NULL").distinct().orderBy("observed_at").collect()]  # a few a micro-batch
    head = ["source_name", "company_id", "run_id", "fetch_complete", "parse_error_count", "total_raw_records"]
    for at in times:
        rows = batch.where(F.col("observed_at") == at)
        batches = rows.select(*head).distinct()
        listed = rows.where("source_job_id IS NOT NULL OR title IS NOT NULL")
        done = reconcile(state, listed, batches, runs, at)
        state = staged(done.state)
        runs = staged(runs.unionByName(done.runs.select(*runs.columns)))
    store.write(batch_id, state=state, runs=runs)


def start(stream: DataFrame, store: VersionedState, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: reconcile_batch(store, batch, batch_id))
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events a type and window, late ones dropped beyond the watermark; an extension, not part of the board."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")).select(F.col("w.start").alias("opened"), "event_type", "n", "most")
