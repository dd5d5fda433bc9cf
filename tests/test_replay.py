"""Replay: every layer's changes are found, and only layers that differ are opened."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestra.operators import adjudication, replay

SCHEMA = "layer string, bid_id long, item string, value string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df, replay.digests(df)


def test_differences_layer_by_layer(spark):
    rows = [("FACT", 1, "a", "x"), ("FACT", 1, "b", "y"), ("RESULT", 1, "r", "PASS"), ("NODE", 1, "n", "T"), ("FACT", 2, "a", "x")]
    other = [("FACT", 1, "b", "y"), ("FACT", 1, "a", "x"), ("RESULT", 1, "r", "FAIL"), ("NODE", 1, "n", "T"), ("NODE", 1, "extra", "T"), ("FACT", 3, "a", "x")]
    got = {tuple(r) for r in replay.differences(*frame(spark, rows), *frame(spark, other)).collect()}
    assert got == {("RESULT", "VERIFICATION_RESULT_MISMATCH", 1, "r", "PASS", "FAIL"), ("NODE", "PROVENANCE_MISMATCH", 1, "extra", None, "T"), ("FACT", "FACT_MISMATCH", 2, "a", "x", None), ("FACT", "FACT_MISMATCH", 3, "a", None, "x")}
    bids = spark.createDataFrame([(1,), (2,), (4,)], "bid_id long")
    verdicts = {r["bid_id"]: (r["status"], r["mismatched"]) for r in replay.verdicts(bids, frame(spark, rows)[1], frame(spark, other)[1]).collect()}
    assert verdicts == {1: ("VERIFICATION_RESULT_MISMATCH", 2), 2: ("FACT_MISMATCH", 1), 4: ("COMPLETE_MATCH", 0)}


def test_repeated_items_count(spark):
    once, twice = [("FACT", 1, "a", "x")], [("FACT", 1, "a", "x")] * 2
    assert replay.differences(*frame(spark, once), *frame(spark, once)).count() == 0
    assert replay.differences(*frame(spark, once), *frame(spark, twice)).count() == 1


def test_what_digests_share_is_not_opened(spark):
    """An item that differs under equal digests would not be looked at: only digests decide what is opened."""
    left, digests = frame(spark, [("FACT", 1, "a", "x")])
    right, _ = frame(spark, [("FACT", 1, "a", "changed")])
    assert replay.differences(left, digests, right, digests).count() == 0


def test_rates_and_steadiness(spark):
    stored, wrong = frame(spark, [("FACT", b, "a", "x") for b in (1, 2)])[1], frame(spark, [("FACT", 1, "a", "x"), ("FACT", 2, "a", "z")])[1]
    bids = spark.createDataFrame([(1,), (2,)], "bid_id long")
    assert tuple(replay.rates(bids, stored, [stored, stored]).first()) == (2, 2, 100.0, 2, 100.0)
    assert tuple(replay.rates(bids, stored, [wrong, stored]).first()) == (2, 1, 50.0, 2, 50.0)


def test_a_planted_change_in_each_layer_is_found(spark, small):
    found = entry.queries()["j03_tampered_snapshot"](spark, small).groupBy("layer").agg(F.count("*").alias("n")).collect()
    assert {r["layer"] for r in found} == set(replay.CATEGORIES) and all(r["n"] for r in found)


def test_adjudications_resolve_in_order_and_leave_records(spark):
    items = spark.createDataFrame([(1, "REV-1-001", "R1"), (1, "REV-1-002", "F1"), (1, "REV-1-003", "PAN")], "bid_id long, review_id string, related string")
    results = spark.createDataFrame([(1, "R1", "FAIL", True), (1, "R2", "MISSING", True)], "bid_id long, requirement_id string, status string, requires_review boolean")
    findings = spark.createDataFrame([(1, "F1", "CONTRADICTION")], "bid_id long, finding_id string, status string")
    ask = lambda k, target, decision, officer="O1", why="a long enough reason", bid=1: (f"A{k}", bid, target, decision, officer, "Name", why, f"2026-01-0{k} 00:00:00")
    rows = [ask(1, "REV-1-001", "accept"), ask(2, "VERIF-1-R1", "CONFIRM_FAIL"), ask(3, " R2 ", "DISMISS"), ask(4, "REV-1-002", "DISMISS"), ask(5, "F1", "ACCEPT"), ask(6, "REV-1-003", "WAIVE"), ask(7, "R1", "ACCEPT", officer=" "), ask(8, "R1", "ACCEPT", why="short"), ask(9, "nothing", "ACCEPT"), ("B1", 2, "R1", "ACCEPT", "O", "N", "a long enough reason", "2026-02-01 00:00:00"), ("B2", 1, "R1", "LOOK", "O", "N", "a long enough reason", "2026-02-01 00:00:00")]
    requests = spark.createDataFrame(rows, "adjudication_id string, bid_id long, target_id string, decision string, officer_id string, officer_name string, justification string, ts string").withColumn("ts", F.to_timestamp("ts"))
    resolved = adjudication.resolved(requests, items, results, findings)
    ruled = adjudication.accepted(resolved)
    assert {r["adjudication_id"]: (r["target_type"], r["requirement_id"], r["finding_id"]) for r in ruled.collect()} == {
        "A1": ("REVIEW_ITEM", "R1", None), "A2": ("REQUIREMENT", "R1", None), "A3": ("REQUIREMENT", "R2", None), "A4": ("REVIEW_ITEM", None, "F1"), "A5": ("INTEGRITY_FINDING", None, "F1"), "A6": ("REVIEW_ITEM", None, None)
    }
    assert {r["adjudication_id"]: r["fault"] for r in adjudication.rejects(resolved).collect()} == {"A7": "OFFICER_ID", "A8": "JUSTIFICATION", "A9": "TARGET", "B1": "TARGET", "B2": "DECISION"}
    assert {r["requirement_id"]: (r["status"], r["requires_review"]) for r in adjudication.results_after(results, ruled).collect()} == {"R1": ("OVERRIDDEN_FAIL", False), "R2": ("MISSING", True)}
    assert adjudication.findings_after(findings, ruled).count() == 0
    assert {r["review_id"]: r["status"] for r in adjudication.items_after(items, ruled).collect()} == {"REV-1-001": "RESOLVED", "REV-1-002": "DISMISSED", "REV-1-003": "RESOLVED"}
    records = {r["adjudication_id"]: (r["previous_status"], r["new_status"]) for r in adjudication.records(ruled, results, findings).collect()}
    assert records == {"A1": ("OPEN", "OVERRIDDEN_PASS"), "A2": ("OVERRIDDEN_PASS", "OVERRIDDEN_FAIL"), "A3": ("MISSING", "MISSING"), "A4": ("OPEN", "DISMISSED"), "A5": ("DISMISSED", "DISMISSED"), "A6": ("OPEN", "UNKNOWN")}
