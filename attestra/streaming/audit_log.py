"""Audit events as a stream: sanitised rows, daily counts and late rows, each appended once.

A micro-batch masks and hashes its rows before anything is kept.  Its watermark is the latest
event time of the batches before it less ``delay``.  Rows of a day that the watermark has
passed go to the table of late rows; the others are appended to the table of rows, a folder a
batch and day.  Days that the batch's own event times carry the watermark past are closed:
their counts are written once, from their folders alone.  All folders are named by batch, so a
batch that is repeated after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.sources import files

ROWS = "ts timestamp, event_type string, who string, print string, batch bigint, day date"
LATE = "ts timestamp, event_type string, who string, print string, day date, batch bigint"
COUNTS = "day date, event_type string, n bigint, masks bigint, first_print string, batch bigint"
MARKS = "latest timestamp, batch bigint"
TABLES = {"rows": ROWS, "late": LATE, "counts": COUNTS, "marks": MARKS}
DELAY = "1 day"


def sanitised(events: DataFrame) -> DataFrame:
    """(ts, event_type, who, print, day): users masked, details as fingerprints."""
    mask = F.concat(F.lit("***"), F.right(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.lit(3)))
    print_of = F.substring(F.sha2(F.coalesce(F.col("props").cast("string"), F.lit("")), 256), 1, 12)
    return events.select("ts", "event_type", mask.alias("who"), print_of.alias("print"), F.to_date("ts").alias("day"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.countDistinct("who").alias("masks"), F.min("print").alias("first_print"))


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def create(spark: SparkSession, path: str) -> None:
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.partitionBy(*(["batch", "day"] if name == "rows" else ["batch"])).mode("ignore").parquet(f"{path}/{name}")


def advance(stream: DataFrame, path: str, delay: str = DELAY) -> None:
    """Take in what has come since the last call for ``path``, which holds the checkpoint and the tables that ``create`` made."""
    spark = stream.sparkSession
    passed = lambda latest: F.col("day").cast("timestamp") + F.expr("INTERVAL 1 DAY") <= latest - F.expr(f"INTERVAL {delay}")

    def put(batch: DataFrame, number: int) -> None:
        clean = sanitised(batch).filter("ts is not null").persist()  # a batch, read four times
        before = table(spark, path, "marks").filter(F.col("batch") < number).agg(F.max("latest")).first()[0]
        newest = clean.agg(F.max("ts")).first()[0]
        gone = F.lit(False) if before is None else passed(F.lit(before))
        late_rows, on_time = clean.filter(gone), clean.filter(~gone)
        on_time.write.mode("overwrite").partitionBy("day").parquet(f"{path}/rows/batch={number}")
        late_rows.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        after = max(x for x in (before, newest) if x is not None) if (before or newest) else None
        closed: Column = F.lit(False) if after is None else passed(F.lit(after)) & ~gone
        kept = table(spark, path, "rows").filter(F.col("batch") <= number).filter(closed)
        counted(kept).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        spark.createDataFrame([(after,)], "latest timestamp").write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        clean.unpersist()

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def open_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts so far of days that are not closed yet."""
    return counted(table(spark, path, "rows").join(F.broadcast(table(spark, path, "counts").select("day").distinct()), "day", "left_anti"))  # a row a day


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, event_type, n, masks, first_print, closed) after all events that are there."""
    from . import overrides

    path = files.scratch(spark, "audit-log")
    create(spark, path)
    advance(overrides.events(spark, sf_dir), path)
    shown = ["day", "event_type", "n", "masks", "first_print"]
    return table(spark, path, "counts").select(*shown, F.lit(True).alias("closed")).unionByName(open_counts(spark, path).select(*shown, F.lit(False).alias("closed")))
