"""The provenance graph: planted faults are found, traces go to any depth and end in cycles."""

import pytest

from attestra.operators import audit, graph

NODES = [("REQ:r", "TENDER_REQUIREMENT"), ("FACT:f", "BIDDER_FACT"), ("BLOCK:b", "PHYSICAL_TEXT_BLOCK"), ("BLOCK:c", "PHYSICAL_TEXT_BLOCK"), ("RESULT:r", "VERIFICATION_RESULT"), ("INTEGRITY:i", "INTEGRITY_FINDING"), ("REVIEW:q", "HUMAN_REVIEW_ITEM"), ("ADJUDICATION:a", "OFFICER_ADJUDICATION")]
EDGES = [
    ("REQ:r", "BLOCK:b", "REQUIREMENT_HAS_EVIDENCE"), ("FACT:f", "BLOCK:c", "FACT_GROUNDED_BY"), ("RESULT:r", "REQ:r", "RESULT_EVALUATES_REQUIREMENT"), ("INTEGRITY:i", "FACT:f", "INTEGRITY_FINDING_COMPARES"),
    ("RESULT:r", "INTEGRITY:i", "RESULT_AFFECTED_BY_INTEGRITY"), ("REVIEW:q", "RESULT:r", "REVIEW_ITEM_FOR_RESULT"), ("ADJUDICATION:a", "REVIEW:q", "ADJUDICATION_FOR_REVIEW_ITEM"),
]


@pytest.fixture
def frames(spark):
    def make(nodes=NODES, edges=EDGES):
        return spark.createDataFrame([(1, *n) for n in nodes], "bid_id long, id string, node_type string"), spark.createDataFrame([(1, *e) for e in edges], "bid_id long, src string, dst string, kind string")

    return make


def found(df):
    return sorted((r["fault"], r["id"]) for r in df.collect())


def test_a_sound_graph_has_no_faults(frames):
    assert found(graph.faults(*frames())) == []


def test_planted_faults(frames):
    nodes = [n for n in NODES if n[0] not in ("BLOCK:c", "REVIEW:q")] + [("FACT:f", "INTEGRITY_FINDING"), ("X:x", "GHOST")]
    edges = [*EDGES, ("REQ:r", "REQ:r", "REQUIREMENT_HAS_EVIDENCE"), ("RESULT:r", "REQ:r", "MADE_UP")]
    assert found(graph.faults(*frames(nodes, edges))) == [
        ("DANGLING_SOURCE", "REVIEW:q > REVIEW_ITEM_FOR_RESULT > RESULT:r"), ("DANGLING_TARGET", "ADJUDICATION:a > ADJUDICATION_FOR_REVIEW_ITEM > REVIEW:q"), ("DANGLING_TARGET", "FACT:f > FACT_GROUNDED_BY > BLOCK:c"),
        ("INVALID_EDGE_TYPE", "RESULT:r > MADE_UP > REQ:r"), ("INVALID_ENDS", "REQ:r > REQUIREMENT_HAS_EVIDENCE > REQ:r"), ("INVALID_NODE_TYPE", "X:x"), ("ORPHAN_NODE", "X:x"),
        ("SELF_LOOP", "REQ:r > REQUIREMENT_HAS_EVIDENCE > REQ:r"), ("TYPE_CONFLICT", "FACT:f"),
    ]


def test_decisions_on_evidence_at_any_depth(frames):
    got = sorted((r["evidence"], r["decision"], r["depth"]) for r in graph.decisions_on(*frames()).collect())
    assert got == [("BLOCK:b", "ADJUDICATION:a", 4), ("BLOCK:b", "RESULT:r", 2), ("BLOCK:b", "REVIEW:q", 3), ("BLOCK:c", "ADJUDICATION:a", 5), ("BLOCK:c", "INTEGRITY:i", 2), ("BLOCK:c", "RESULT:r", 3), ("BLOCK:c", "REVIEW:q", 4)]
    assert sorted((r["evidence"], r["depth"]) for r in graph.evidence_of(*frames()).collect()) == [("BLOCK:b", 2), ("BLOCK:c", 3)]


def test_traces_end_in_cycles(frames):
    nodes, edges = frames(edges=[*EDGES, ("BLOCK:b", "ADJUDICATION:a", "MADE_UP")])
    reached = graph.reached(edges, nodes.selectExpr("bid_id", "id as root").filter("root = 'BLOCK:b'"), up=True).collect()
    assert sorted((r["id"], r["depth"]) for r in reached) == [("ADJUDICATION:a", 4), ("REQ:r", 1), ("RESULT:r", 2), ("REVIEW:q", 3)]
    assert [r["bid_id"] for r in audit.cyclic_bids(edges).collect()] == [1]
    assert graph.reached(edges.limit(0), nodes.selectExpr("bid_id", "id as root"), up=True).count() == 0


def test_traces_of_facts_and_findings(frames):
    got = {r["id"]: (r["rests_on"], r["used_by"]) for r in graph.traces(*frames()).collect()}
    assert got == {"FACT:f": ("FACT_GROUNDED_BY>BLOCK:c", "INTEGRITY_FINDING_COMPARES>INTEGRITY:i"), "INTEGRITY:i": ("INTEGRITY_FINDING_COMPARES>FACT:f", "RESULT_AFFECTED_BY_INTEGRITY>RESULT:r")}


def test_pages_bound_a_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "PAGE", 3)
    rows = graph.paged(spark.range(7).select(F.lit(1).alias("bid_id"), F.lit("k").alias("kind"), F.col("id").cast("string").alias("x")), "kind", F.col("x")).orderBy("page").collect()
    assert [(r["page"], r["n"], r["lines"]) for r in rows] == [(0, 3, "0;1;2"), (1, 3, "3;4;5"), (2, 1, "6")]
