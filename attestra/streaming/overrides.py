"""Officer decisions as a stream: the decision in force for each target is kept as keyed state.

Each target has a state of its own: its latest decision by (time, event id), how many there
were, and which events have been seen, so that repeats change nothing.  A micro-batch touches
the targets that it names alone, and what is written is the changes, a folder a batch that a
repeated batch replaces; so cost follows the batch, and a restart from the checkpoint goes on
where the last run stopped.  No watermark drops a decision, however late it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attestra.operators import audit
from attestra.sources import files

CHANGES = "target bigint, decision string, ts timestamp, event_id bigint, n bigint"
#: How long a seen event is remembered; one that comes again later still is counted again, which changes no decision in force.
REMEMBERED_MS = 90 * 24 * 3600 * 1000
#: Keyed state needs this store; and batches without data, which only let memories expire, would never end a run to the end of what is there.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class LatestDecision(StatefulProcessor):
    """State of one target: the decision in force, and the events seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "decision string, at bigint, event_id bigint, n bigint")
        self.seen = handle.getMapState("seen", "event_id bigint", "known boolean", ttlDurationMs=REMEMBERED_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.latest.get() if self.latest.exists() else None
        place = (before[1], before[2]) if before else None
        decision, n = (before[0], before[3]) if before else (None, 0)
        changed = False
        for row in rows:
            if self.seen.containsKey((row.event_id,)):
                continue
            self.seen.updateValue((row.event_id,), (True,))
            n, changed = n + 1, True
            if place is None or (row.at, row.event_id) > place:
                place, decision = (row.at, row.event_id), row.decision
        if changed:
            self.latest.update((decision, *place, n))
            yield Row(target=key[0], decision=decision, at=place[0], event_id=place[1], n=n)

    def close(self) -> None:
        pass


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def advance(stream: DataFrame, path: str) -> None:
    """Take in what has come since the last call for ``path``, which holds checkpoint and changes."""
    spark = stream.sparkSession
    files.ship(spark)
    decided = audit.decisions(stream).select(F.col("target").cast("long").alias("target"), "decision", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"))
    kept = decided.filter("target is not null and event_id is not null and at is not null").groupBy("target").transformWithState(LatestDecision(), CHANGES.replace("ts timestamp", "at bigint"), "Update", "ProcessingTime")
    changes = kept.select("target", "decision", F.timestamp_micros("at").alias("ts"), "event_id", "n")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    known = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)  # a query keeps what it was started with
        changes.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)


def in_force(spark: SparkSession, path: str) -> DataFrame:
    """(target, decision, ts, event_id, n): the last change of each target."""
    changes = spark.read.schema(f"{CHANGES}, batch bigint").option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    return changes.groupBy("target").agg(F.max_by(F.struct("decision", "ts", "event_id", "n"), F.col("batch")).alias("x")).select("target", "x.*")


def effective_of(stream: DataFrame) -> DataFrame:
    """(target, decision) in force after all that ``stream`` holds now."""
    spark = stream.sparkSession
    path = files.scratch(spark, "overrides")
    spark.createDataFrame([], CHANGES).write.parquet(f"{path}/changes/batch=-1")  # where no decision comes
    advance(stream, path)
    return in_force(spark, path).select("target", "decision")


def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective_of(events(spark, sf_dir))
