"""The provenance graph: nodes from their own tables, checks of its structure, traces of any depth."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.sources import files

from . import resolve, rollup

# The types of nodes, and which types each kind of edge joins.
NODE_TYPES = ("TENDER_REQUIREMENT", "BIDDER_FACT", "PHYSICAL_TEXT_BLOCK", "CANONICAL_FIELD", "VERIFICATION_RESULT", "INTEGRITY_FINDING", "HUMAN_REVIEW_ITEM", "OFFICER_ADJUDICATION")
EDGE_TYPES = {
    "REQUIREMENT_HAS_EVIDENCE": ("TENDER_REQUIREMENT", "PHYSICAL_TEXT_BLOCK"),
    "FACT_SATISFIES_REQUIREMENT": ("BIDDER_FACT", "TENDER_REQUIREMENT"),
    "FACT_GROUNDED_BY": ("BIDDER_FACT", "PHYSICAL_TEXT_BLOCK"),
    "FACT_CANONICALIZED_AS": ("BIDDER_FACT", "CANONICAL_FIELD"),
    "RESULT_EVALUATES_REQUIREMENT": ("VERIFICATION_RESULT", "TENDER_REQUIREMENT"),
    "RESULT_EVALUATES_FACT": ("VERIFICATION_RESULT", "BIDDER_FACT"),
    "RESULT_SUPPORTED_BY": ("VERIFICATION_RESULT,INTEGRITY_FINDING", "PHYSICAL_TEXT_BLOCK"),
    "RESULT_AFFECTED_BY_INTEGRITY": ("VERIFICATION_RESULT", "INTEGRITY_FINDING"),
    "INTEGRITY_FINDING_COMPARES": ("INTEGRITY_FINDING", "BIDDER_FACT"),
    "REVIEW_ITEM_FOR_RESULT": ("HUMAN_REVIEW_ITEM", "VERIFICATION_RESULT,INTEGRITY_FINDING"),
    "REVIEW_ITEM_SUPPORTED_BY": ("HUMAN_REVIEW_ITEM", "PHYSICAL_TEXT_BLOCK"),
    "ADJUDICATION_FOR_REVIEW_ITEM": ("OFFICER_ADJUDICATION", "HUMAN_REVIEW_ITEM"),
    "ADJUDICATION_OVERRIDES_RESULT": ("OFFICER_ADJUDICATION", "VERIFICATION_RESULT"),
}
DECIDED = ("VERIFICATION_RESULT", "INTEGRITY_FINDING", "HUMAN_REVIEW_ITEM", "OFFICER_ADJUDICATION")
#: Ids on one page of a serialised graph.
PAGE = 500
#: Wrong ids go to every executor up to so many (some 100 bytes each); more are joined by a shuffle.
MOST_SENT = 500_000
#: Beginnings of ids that are told apart by name; where there are more, edges are not parted by them. It changes no result.
MOST_STARTS = 100


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def nodes(bids: DataFrame, requirements: DataFrame, documents: DataFrame, facts: DataFrame, results: DataFrame, findings: DataFrame, queue: DataFrame, decisions: DataFrame, checks: DataFrame) -> DataFrame:
    """(bid_id, id, node_type), each once, every type from the table that declares its things, whatever edges there are.

    ``documents`` are the submitted pages (bid_id, source_document, page); ``decisions`` name
    their bid as ``target``.  A canonical field is a node where a fact of the bid resolves to it.
    Submitted pages, facts and findings are one row each, and are not looked through for repeats.
    """
    node = lambda df, kind, name: df.select("bid_id", name.alias("id"), F.lit(kind).alias("node_type"))
    named = lambda kind, *parts: F.concat(F.lit(f"{kind}:"), F.concat_ws(":", *parts))
    asked = bids.join(F.broadcast(requirements.select("tender_id", "requirement_id")), "tender_id")  # a list of clauses
    verified = checks.filter("status = 'VERIFIED'")
    told_twice = [
        node(asked, "TENDER_REQUIREMENT", named("REQ", "requirement_id")),
        node(bids, "PHYSICAL_TEXT_BLOCK", F.concat(F.lit("BLOCK:"), "tender_id", F.lit(".pdf:1"))),
        node(verified, "PHYSICAL_TEXT_BLOCK", named("BLOCK", "registry", F.coalesce("identifier", F.lit("")))),
        node(verified.select("bid_id", "registry", F.explode(F.map_keys(F.map_filter("details", lambda _, v: v.isNotNull()))).alias("known")), "BIDDER_FACT", F.concat(F.lit("FACT:"), F.lower("registry"), F.lit("."), "known")),
        node(resolve.with_canonical(facts, "field").filter("canonical is not null").select("bid_id", "canonical").distinct(), "CANONICAL_FIELD", named("FIELD", "canonical")),
        node(results, "VERIFICATION_RESULT", named("RESULT", "requirement_id")),
        node(queue.filter("source_order <> 2"), "HUMAN_REVIEW_ITEM", F.concat(F.lit("REVIEW:"), "related")),
        node(decisions.withColumnRenamed("target", "bid_id").join(bids.select("bid_id"), "bid_id", "left_semi"), "OFFICER_ADJUDICATION", F.concat(F.lit("ADJUDICATION:"), F.col("event_id").cast("string"))),
    ]
    once = [
        node(documents, "PHYSICAL_TEXT_BLOCK", named("BLOCK", "source_document", "page")),
        node(facts, "BIDDER_FACT", F.concat(F.lit("FACT:"), F.concat_ws("-", "field", "fact_seq"))),
        node(findings, "INTEGRITY_FINDING", F.concat(F.lit("INTEGRITY:"), rollup.finding_id())),
        node(queue.filter("source_order = 2"), "HUMAN_REVIEW_ITEM", F.concat(F.lit("REVIEW:"), "related")),  # findings
    ]
    return _union([_union(told_twice).distinct(), *once])


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(bid_id, fault, id) of everything that is wrong with a graph.

    ``DANGLING_SOURCE`` and ``DANGLING_TARGET``: an edge's end is no node; ``SELF_LOOP``;
    ``INVALID_EDGE_TYPE``; ``INVALID_ENDS``: a kind of edge between types that it does not join;
    ``TYPE_CONFLICT``: an id of several types; ``INVALID_NODE_TYPE``; ``ORPHAN_NODE``: a node
    without any edge.  Edges are named ``source > kind > target``.
    """
    c, kinds = F.col, list(EDGE_TYPES)
    bit = lambda names, x: F.coalesce(F.element_at(F.create_map(*[v for k, n in enumerate(names) for v in (F.lit(n), F.lit(1 << k))]), x), F.lit(1 << len(names)))
    # Of an id: its types, and the kinds of edges that begin and end there, as bits; hashes tell apart types that are both unknown.
    none = F.lit(None)
    end = lambda id, begins, ends: F.struct(id.alias("id"), none.cast("int").alias("types"), none.cast("long").alias("h"), begins.alias("begins"), ends.alias("ends"))
    declared = nodes.select("bid_id", "id", bit(NODE_TYPES, c("node_type")).alias("types"), F.when(c("node_type").isNotNull(), F.xxhash64("node_type")).alias("h"), F.lit(0).alias("begins"), F.lit(0).alias("ends"))
    met = edges.select("bid_id", F.inline(F.array(end(c("src"), bit(kinds, c("kind")), F.lit(0)), end(c("dst"), F.lit(0), bit(kinds, c("kind"))))))
    seen = declared.unionByName(met).groupBy("bid_id", "id").agg(F.bit_or("types").alias("types"), F.min("h").alias("low"), F.max("h").alias("high"), F.bit_or("begins").alias("begins"), F.bit_or("ends").alias("ends"))
    # Whether an edge of some kind begins (0) or ends (1) at an id of other types than it joins.
    allowed = lambda n, side: sum(1 << NODE_TYPES.index(t) for t in EDGE_TYPES[n][side].split(","))
    refused = lambda side: functools.reduce(Column.__or__, [(c(("begins", "ends")[side]).bitwiseAND(1 << k) != 0) & (c("types").bitwiseAND(allowed(n, side)) == 0) for k, n in enumerate(kinds)])
    told = F.struct((c("types").isNull() | refused(0) | refused(1)).alias("bad"), (c("low") != c("high")).alias("conflict"), (c("types").isNotNull() & (c("begins") == 0) & (c("ends") == 0)).alias("orphan"))
    # One pass over nodes and edges finds the ids with which anything is wrong; they are written, and only edges at them are looked at one by one.
    path = files.scratch(nodes.sparkSession, "wrong-ids")
    seen.select("bid_id", "id", "types", told.alias("x")).select("bid_id", "id", "types", "x.*").filter("bad or conflict or orphan").write.parquet(path)
    seen = nodes.sparkSession.read.parquet(path)
    bad = seen.filter("bad").select("bid_id", "id", "types")  # ids that edges cannot have, or not of all kinds
    if bad.count() <= MOST_SENT:
        bad = F.broadcast(bad)
    bad_ends = edges.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("id", F.when(c("side") == 0, c("src")).otherwise(c("dst"))).join(bad, ["bid_id", "id"])
    joined = F.element_at(F.create_map(*[x for n in kinds for x in (F.lit(n), F.array(F.lit(allowed(n, 0)), F.lit(allowed(n, 1))))]), c("kind"))
    lost = F.when(c("types").isNull(), F.when(c("side") == 0, "DANGLING_SOURCE").otherwise("DANGLING_TARGET")).when(F.get(joined, c("side")).bitwiseAND(c("types")) == 0, "INVALID_ENDS")
    name = F.concat_ws(" > ", "src", "kind", "dst")
    fault = lambda df, kind, what: df.select("bid_id", F.lit(kind).alias("fault"), what.alias("id"))
    at_ends = bad_ends.select("bid_id", "src", "dst", "kind", "side", lost.alias("fault")).filter("fault is not null")
    return _union([
        at_ends.filter("fault <> 'INVALID_ENDS'").select("bid_id", "fault", name.alias("id")),
        fault(at_ends.filter("fault = 'INVALID_ENDS'").select("bid_id", "src", "dst", "kind").distinct(), "INVALID_ENDS", name),
        fault(edges.filter("src = dst"), "SELF_LOOP", name),
        fault(edges.filter(~c("kind").isin(kinds)), "INVALID_EDGE_TYPE", name),
        fault(seen.filter("conflict"), "TYPE_CONFLICT", c("id")),
        fault(nodes.filter(~c("node_type").isin(*NODE_TYPES)), "INVALID_NODE_TYPE", c("id")),
        fault(seen.filter("orphan"), "ORPHAN_NODE", c("id")),
    ])


def paged(df: DataFrame, kind: str, line: Column) -> DataFrame:
    """(bid_id, kind, page, n, lines): a serialised graph, its lines in order, ``PAGE`` of them at most in a row, so that no row grows with a bid."""
    place = F.row_number().over(Window.partitionBy("bid_id", kind).orderBy("line"))
    placed = df.select("bid_id", kind, line.alias("line")).withColumn("page", F.floor((place - 1) / PAGE).cast("int"))
    return placed.groupBy("bid_id", kind, "page").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("line")), ";").alias("lines"))


def start(id: str) -> Column:
    """What an id begins with, before its first colon: of the ids made here, their kind."""
    return F.substring_index(id, ":", 1)


def reached(edges: DataFrame, roots: DataFrame, *, up: bool) -> DataFrame:
    """(bid_id, root, id, depth): all that can be reached from each root (bid_id, root), and in how many steps at least.

    ``up`` follows edges from their target to their source.  Each round goes one step on from
    what the last one found first and leaves out what was found before, so cycles end; rounds
    are written tables, which are kept as parts of the answer, and grow with the longest path.
    """
    spark, (near, far) = edges.sparkSession, ("dst", "src") if up else ("src", "dst")
    steps = edges.select("bid_id", F.col(near).alias("id"), F.col(far).alias("next"))
    base, depth = files.scratch(spark, "reached"), 0
    roots.select("bid_id", "root", F.col("root").alias("id")).distinct().write.parquet(f"{base}/depth=0")
    while True:
        found = spark.read.option("basePath", base).parquet(f"{base}/depth=*")
        last = found.filter(F.col("depth") == depth)  # a folder of its own
        begin = [r[0] for r in last.select(start("id")).distinct().limit(MOST_STARTS + 1).collect()]  # kinds of ids, or one more than are asked for
        if not begin:
            return found.select("bid_id", "root", "id", "depth").filter("depth > 0")
        ahead = steps if len(begin) > MOST_STARTS else steps.filter(start("id").isin(begin))  # only edges that can be gone along in this round are dealt out
        new = last.join(ahead, ["bid_id", "id"]).select("bid_id", "root", F.col("next").alias("id")).distinct()
        depth += 1
        new.join(found.select("bid_id", "root", "id"), ["bid_id", "root", "id"], "left_anti").write.parquet(f"{base}/depth={depth}")


def decisions_on(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(bid_id, evidence, decision, node_type, depth): results, findings, review items and adjudications that rest on each block, at any depth."""
    blocks = nodes.filter("node_type = 'PHYSICAL_TEXT_BLOCK'").select("bid_id", F.col("id").alias("root"))
    decided = nodes.filter(F.col("node_type").isin(*DECIDED)).select("bid_id", "id", "node_type")
    return reached(edges, blocks, up=True).join(decided, ["bid_id", "id"]).select("bid_id", F.col("root").alias("evidence"), F.col("id").alias("decision"), "node_type", "depth")


def evidence_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(bid_id, result, evidence, depth): the blocks that each result rests on, at any depth."""
    results = nodes.filter("node_type = 'VERIFICATION_RESULT'").select("bid_id", F.col("id").alias("root"))
    blocks = nodes.filter("node_type = 'PHYSICAL_TEXT_BLOCK'").select("bid_id", "id")
    return reached(edges, results, up=False).join(blocks, ["bid_id", "id"]).select("bid_id", F.col("root").alias("result"), F.col("id").alias("evidence"), "depth")


def traces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(bid_id, id, node_type, rests_on, used_by) of each fact and finding: its edges to and from other nodes, as sorted ``kind>id`` lists."""
    asked = nodes.filter("node_type in ('BIDDER_FACT', 'INTEGRITY_FINDING')")
    listed = lambda a, b, out: edges.groupBy("bid_id", F.col(a).alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(">", "kind", b))), ",").alias(out))
    return asked.join(listed("src", "dst", "rests_on"), ["bid_id", "id"], "left").join(listed("dst", "src", "used_by"), ["bid_id", "id"], "left").select("bid_id", "id", "node_type", "rests_on", "used_by")
