"""Streams: keyed state survives a restart, late rows are told apart, everything is written once to the shared folder."""

import shutil

import pytest

import __spark_entry__ as entry
from attestra.sources import files
from attestra.streaming import audit_log, overrides

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, props string"


@pytest.fixture
def feed(spark, tmp_path):
    """Adds a file of events, and gives the stream of all files, one a micro-batch."""
    folder = tmp_path / "feed"
    folder.mkdir()

    def add(*rows):
        part = tmp_path / f"part-{len(list(folder.iterdir()))}"
        spark.createDataFrame([(i, t, u, e, "{}") for i, t, u, e in rows], "event_id bigint, ts string, user_id bigint, event_type string, props string").withColumn("ts", __import__("pyspark").sql.functions.to_timestamp("ts")).coalesce(1).write.parquet(str(part))
        shutil.move(next(part.glob("*.parquet")), folder / f"{len(list(folder.iterdir())):03d}.parquet")
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return add


def test_streams_write_to_the_shared_folder(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch", lambda spark, label: f"file://{tmp_path}/{label}-{len(list(tmp_path.iterdir()))}")
    for name in ("s01_override_stream", "s02_audit_stream"):
        got = entry.queries()[name](spark, small)
        assert got.count() > 0
        found = got.inputFiles()
        assert found and all(str(tmp_path) in f for f in found)
    assert len(list(tmp_path.glob("*/checkpoint/offsets"))) == 2


def test_late_decisions_count_and_repeats_do_not(spark, feed, tmp_path):
    """A decision that comes years after newer ones of other targets is in force all the same."""
    path = f"file://{tmp_path}/state"
    feed((1, "2026-01-01 00:00:00", 7, "purchase"), (1, "2026-01-01 00:00:00", 7, "purchase"))
    feed((2, "2020-01-01 00:00:00", 8, "error"), (3, "2019-01-01 00:00:00", 7, "error"))
    stream = feed((4, "2026-02-01 00:00:00", 8, "signup"), (5, "2018-01-01 00:00:00", 9, "click"), (6, "2018-01-01 00:00:00", 9, "view"))
    overrides.advance(stream, path)
    now = lambda: {(r["target"], r["decision"], r["n"]) for r in overrides.in_force(spark, path).collect()}
    assert now() == {(7, "ACCEPT", 2), (8, "WAIVE", 2), (9, "DISMISS", 1)}
    stream = feed((1, "2026-01-01 00:00:00", 7, "purchase"), (7, "2026-03-01 00:00:00", 8, "error"))  # a restart: one event comes again
    overrides.advance(stream, path)
    assert now() == {(7, "ACCEPT", 2), (8, "CONFIRM_FAIL", 3), (9, "DISMISS", 1)}
    last = spark.read.parquet(f"{path}/changes/batch=3").collect()
    assert [(r["target"], r["decision"]) for r in last] == [(8, "CONFIRM_FAIL")]  # what a batch writes is what it changes
    overrides.advance(stream, path)  # nothing new
    assert now() == {(7, "ACCEPT", 2), (8, "CONFIRM_FAIL", 3), (9, "DISMISS", 1)}


def test_a_stream_without_decisions(spark, feed):
    assert overrides.effective_of(feed((1, "2026-01-01 00:00:00", 7, "view"))).count() == 0


def test_audit_rows_counts_and_late_rows_are_appended_once(spark, feed, tmp_path):
    path = f"file://{tmp_path}/log"
    audit_log.create(spark, path)
    counts = lambda: sorted((str(r["day"]), r["event_type"], r["n"], r["batch"]) for r in audit_log.table(spark, path, "counts").collect())
    feed((1, "2026-01-01 10:00:00", 107, "error"), (2, "2026-01-01 11:00:00", 108, "error"))
    feed((3, "2026-01-02 10:00:00", 107, "error"), (4, "2026-01-01 23:00:00", 107, "view"))  # a day late, within the delay
    audit_log.advance(feed((5, "2026-01-03 12:00:00", 109, "view")), path)  # closes the first of January
    assert counts() == [("2026-01-01", "error", 2, 2), ("2026-01-01", "view", 1, 2)]
    audit_log.advance(feed((6, "2026-01-01 12:00:00", 107, "error"), (7, "2026-01-05 00:00:00", 107, "view")), path)  # too late; closes the second and the third
    assert counts() == [("2026-01-01", "error", 2, 2), ("2026-01-01", "view", 1, 2), ("2026-01-02", "error", 1, 3), ("2026-01-03", "view", 1, 3)]
    late = audit_log.table(spark, path, "late").collect()
    assert [(str(r["ts"]), r["who"]) for r in late] == [("2026-01-01 12:00:00", "***107")]
    assert [(str(r["day"]), r["n"]) for r in audit_log.open_counts(spark, path).collect()] == [("2026-01-05", 1)]
    assert audit_log.table(spark, path, "rows").count() == 6
    assert "user-107" not in str(audit_log.table(spark, path, "rows").collect())
