"""The store of dossiers: reads by id touch little, writes replace their ids alone and are seen whole."""

import pytest
from pyspark.sql import functions as F

from attestra.sources import dossiers


def rows(spark, ids, mark):
    return spark.createDataFrame([(i,) for i in ids], "bid_id long").select("bid_id", F.lit(mark).alias("mark"), F.array(F.struct(F.col("bid_id").cast("string").alias("requirement_id"), F.lit("PASS").alias("status"))).alias("results"), F.repeat(F.sha2(F.col("bid_id").cast("string"), 256), 20).alias("filler"))


def scanned(df):
    """Rows that the scans of a plan gave after it has run."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if "FileSourceScan" in node.getClass().getSimpleName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        dossiers.all_rows(spark, path)
    dossiers.upsert(rows(spark, range(20_000), "first"), path, "bid_id", buckets=4, row_group=1 << 16)
    assert dossiers.all_rows(spark, path).count() == 20_000
    one = dossiers.by_ids(spark, path, "bid_id", [777], buckets=4)
    assert [(r["mark"], r["results"][0]["requirement_id"]) for r in one.collect()] == [("first", "777")]
    assert 0 < scanned(one) <= 3_000  # of 20,000: one bucket's few row groups
    before = {p.name for p in (tmp_path / "store" / "data").iterdir()}
    dossiers.upsert(rows(spark, [777, 20_001], "second"), path, "bid_id", buckets=4, row_group=1 << 16)
    after = {p.name for p in (tmp_path / "store" / "data").iterdir()} - before
    touched = [p for v in after for p in (tmp_path / "store" / "data" / v).glob("bucket=*")]
    assert 1 <= len(touched) <= 2  # the buckets of its ids alone
    whole = {r["mark"]: r["count"] for r in dossiers.all_rows(spark, path).groupBy("mark").count().collect()}
    assert whole == {"first": 19_999, "second": 2}
    assert {r["bid_id"]: r["mark"] for r in dossiers.by_ids(spark, path, "bid_id", [776, 777, 20_001, 99_999], buckets=4).collect()} == {776: "first", 777: "second", 20_001: "second"}
    dossiers.vacuum(spark, path)
    assert dossiers.all_rows(spark, path).count() == 20_001


def test_a_write_that_fails_leaves_the_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    dossiers.upsert(rows(spark, range(10), "first"), path, "bid_id")
    with pytest.raises(Exception):
        dossiers.upsert(rows(spark, range(5), "second").withColumn("mark", F.raise_error(F.lit("lost"))), path, "bid_id")
    (tmp_path / "store" / "data" / "torn" / "bucket=0").mkdir(parents=True)  # data of a write that never came to its commit
    assert {r["mark"] for r in dossiers.all_rows(spark, path).collect()} == {"first"} and dossiers.all_rows(spark, path).count() == 10


def test_a_write_is_as_large_as_its_rows_and_as_wide_as_its_tasks(spark, tmp_path):
    path = tmp_path / "store"
    dossiers.upsert(rows(spark, range(200), "first").repartition(6), f"file://{path}", "bid_id", buckets=4)
    parts = list((path / "data").rglob("*.parquet"))
    assert sum(p.stat().st_size for p in parts) < 2_000_000  # a Bloom filter of 1 MB for each row group, however few its ids, made it over 4 MB
    assert len(parts) > 4  # tasks write what they have; dealt out by bucket, four tasks at most had rows
    dossiers.upsert(rows(spark, range(190, 210), "second").repartition(3), f"file://{path}", "bid_id", buckets=4)
    assert {r["mark"]: r["count"] for r in dossiers.all_rows(spark, f"file://{path}").groupBy("mark").count().collect()} == {"first": 190, "second": 20}


def test_dossiers_of_some_bids_nest_nothing_of_others(spark, small, monkeypatch):
    from attestra.operators import audit
    from attestra.plans import evaluation_queries as queries

    given, build = [], audit.dossiers
    monkeypatch.setattr(audit, "dossiers", lambda *parts: given.append(parts) or build(*parts))
    some = queries.bridge.bids(spark, small).orderBy("bid_id").limit(2).select("bid_id").localCheckpoint()
    found = {r["bid_id"]: r for r in queries.dossiers(spark, small, only=some).collect()}
    mine = {r["bid_id"] for r in some.collect()}
    assert all({r["bid_id"] for r in df.select("bid_id").distinct().collect()} <= mine for df in given[0])
    assert found == {r["bid_id"]: r for r in queries.dossiers(spark, small).join(some, "bid_id", "left_semi").collect()} and found.keys() == mine
