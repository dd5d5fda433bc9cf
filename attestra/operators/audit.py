"""Provenance edges, snapshots, replay differences and officer overrides."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.sources import files

from . import graph, integrity, resolve, rollup

#: Event types that stand for officer decisions.
DECISIONS = {"purchase": "ACCEPT", "signup": "WAIVE", "error": "CONFIRM_FAIL", "click": "DISMISS"}
SNAPSHOT_VERSIONS = ("1.0",)


#: Pairs of beginnings of ids that are looked through for circles; where there are more, all edges are looked at. It changes no result.
MOST_TOPS = 1000


def _node(kind: str, *parts: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(":", *parts))


def _fact(field: str, seq: str) -> Column:
    return F.concat(F.lit("FACT:"), F.concat_ws("-", field, seq))


def _edge(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return df.select("bid_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))


def grounded(facts: DataFrame, checks: DataFrame) -> list[DataFrame]:
    """The edges of facts to the blocks that they are found in, and of facts of verified registry records to those; they need no other table."""
    told = checks.filter("status = 'VERIFIED'").select("bid_id", "registry", F.coalesce("identifier", F.lit("")).alias("identifier"), F.explode(F.map_keys(F.map_filter("details", lambda _, v: v.isNotNull()))).alias("known"))
    return [
        _edge(facts, _fact("field", "fact_seq"), _node("BLOCK", "source_document", "page"), "FACT_GROUNDED_BY"),
        _edge(told, F.concat(F.lit("FACT:"), F.lower("registry"), F.lit("."), "known"), _node("BLOCK", "registry", "identifier"), "FACT_GROUNDED_BY"),
    ]


def edges(results: DataFrame, facts: DataFrame, findings: DataFrame, queue: DataFrame, checks: DataFrame, decided: DataFrame) -> DataFrame:
    """(bid_id, src, dst, kind), each once: what rests on what in a bid.

    Facts resolve to canonical fields, satisfy requirements and are found in blocks, as requirements
    are; results evaluate requirements and facts, are supported by blocks, and are affected by
    findings of their field; findings compare facts and are supported by blocks; review items are for results or findings; decisions override results and
    settle review items; facts of verified registry records rest on those.

    A fact or a finding is one row, and queued once, so its edges are made in one pass over it with
    the list of its bid's results, which the clauses of a tender bound; only what other tables may
    tell twice is looked through for repeats.
    """
    edge, c = _edge, F.col
    result, requirement, block = _node("RESULT", "requirement_id"), _node("REQ", "requirement_id"), _node("BLOCK", "source_document", "page")
    told = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    each = lambda df, *lists: df.select("bid_id", F.inline(F.concat(*lists)))
    evaluated = c("basis") == "EVALUATED"
    own = F.struct("requirement_id", F.lower("field").alias("rf"), c("canonical").alias("rc"), F.when(evaluated, c("actual")).alias("actual"), "source_document", "page", c("status").isin("PASS", "PARTIAL").alias("met"))
    listed = results.groupBy("bid_id").agg(F.collect_set(own).alias("own"))
    of = lambda kind, x: F.concat(F.lit(f"{kind}:"), x["requirement_id"])
    fact = _fact("field", "fact_seq")
    same = lambda x: (x["actual"] == c("value")) & (x["source_document"] == c("source_document")) & (x["page"] == c("page")) & ((x["rf"] == c("f")) | (x["rc"] == c("g")))
    held = resolve.with_canonical(facts, "field").withColumns({"f": F.lower("field"), "g": integrity.grouped_field(c("canonical"), c("field"))})
    held = held.join(listed, "bid_id", "left").withColumn("used", F.coalesce(F.filter("own", same), F.array().cast(listed.schema["own"].dataType))).drop("own").withColumn("fact", fact)
    finding = F.concat(F.lit("INTEGRITY:"), rollup.finding_id())
    near = lambda x: x["rf"].isNotNull() & ((x["rc"] == c("field")) | x["rf"].isin(F.lower("field"), c("raw_field_a"), c("raw_field_b")))
    found = findings.join(listed, "bid_id", "left").withColumn("touched", F.coalesce(F.filter("own", near), F.array().cast(listed.schema["own"].dataType))).drop("own").withColumn("finding", finding)
    item = F.concat(F.lit("REVIEW:"), "related")
    of_result, of_finding = queue.filter("source_order = 1"), queue.filter("source_order = 2")
    shown = of_result.join(results.filter("source_document is not null").select("bid_id", F.col("requirement_id").alias("related"), "source_document", "page"), ["bid_id", "related"])
    settled = results.filter("field = 'turnover_cr' and basis <> 'SUPERSEDED'").join(decided.select(F.col("target").alias("bid_id"), "event_id"), "bid_id")
    decision = F.concat(F.lit("ADJUDICATION:"), F.col("event_id").cast("string"))
    registered = grounded(facts, checks)[1]
    repeated = [
        registered,
        each(
            results.select("bid_id", "tender_id", "requirement_id", "source_document", "page", evaluated.alias("evaluated")).distinct(),
            F.array(told(requirement, F.concat(F.lit("BLOCK:"), "tender_id", F.lit(".pdf:1")), "REQUIREMENT_HAS_EVIDENCE"), told(result, requirement, "RESULT_EVALUATES_REQUIREMENT")),
            F.array_compact(F.array(F.when(c("evaluated"), told(result, block, "RESULT_SUPPORTED_BY")))),
        ),
        edge(of_result, item, F.concat(F.lit("RESULT:"), "related"), "REVIEW_ITEM_FOR_RESULT"),
        edge(shown, item, block, "REVIEW_ITEM_SUPPORTED_BY"),
        edge(settled, decision, result, "ADJUDICATION_OVERRIDES_RESULT"),
        edge(settled.join(of_result.select("bid_id", F.col("related").alias("requirement_id")), ["bid_id", "requirement_id"], "left_semi"), decision, F.concat(F.lit("REVIEW:"), "requirement_id"), "ADJUDICATION_FOR_REVIEW_ITEM"),
    ]
    once = [
        each(
            held,
            F.array(told(c("fact"), block, "FACT_GROUNDED_BY")),
            F.array_compact(F.array(F.when(c("canonical").isNotNull(), told(c("fact"), _node("FIELD", "canonical"), "FACT_CANONICALIZED_AS")))),
            F.transform("used", lambda x: told(of("RESULT", x), c("fact"), "RESULT_EVALUATES_FACT")),
            F.transform(F.filter("used", lambda x: x["met"]), lambda x: told(c("fact"), of("REQ", x), "FACT_SATISFIES_REQUIREMENT")),
        ),
        each(
            found,
            F.array(*[told(c("finding"), _node("BLOCK", f"document_{x}", f"page_{x}"), "RESULT_SUPPORTED_BY") for x in "ab"], *[told(c("finding"), _fact(f"raw_field_{x}", f"seq_{x}"), "INTEGRITY_FINDING_COMPARES") for x in "ab"]),
            F.transform("touched", lambda x: told(of("RESULT", x), c("finding"), "RESULT_AFFECTED_BY_INTEGRITY")),
        ),
        edge(of_finding, item, F.concat(F.lit("INTEGRITY:"), "related"), "REVIEW_ITEM_FOR_RESULT"),
    ]
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union([union(repeated).distinct(), *once])


def cyclic_bids(edges: DataFrame) -> DataFrame:
    """(bid_id) of bids with a cycle.

    A cycle also runs in a circle through the beginnings of its ids (``graph.start``), so only edges
    that lie on a circle of those are looked at; in a sound graph there are none. Of them, edges
    whose end leads nowhere are taken away until none is left or none goes; what stays
    lies on or leads to a cycle.  The rounds grow with the longest path of those edges; each round is a written table.
    """
    spark, left, before, path = edges.sparkSession, edges.select("bid_id", "src", "dst"), -1, ""
    a, b = graph.start("src"), graph.start("dst")
    tops = {tuple(r) for r in left.select(a.alias("a"), b.alias("b")).distinct().limit(MOST_TOPS + 1).collect()}  # pairs of kinds of ids, or one more than are asked for
    if len(tops) <= MOST_TOPS:
        reach = set(tops)
        while more := {(x, z) for x, y in reach for w, z in tops if w == y} - reach:
            reach |= more
        on_circle = [f"{x} {y}" for x, y in tops if (y, x) in reach or x == y]
        left = left.filter(F.concat_ws(" ", a, b).isin(on_circle))
    left = left.distinct()
    while True:
        path, last = files.scratch(spark, "cycle-search"), path
        left.write.parquet(path)
        left = spark.read.parquet(path)
        if last:
            files.drop(spark, last)
        n = left.count()
        if n in (0, before):
            return left.select("bid_id").distinct()
        before = n
        left = left.join(left.select("bid_id", F.col("src").alias("dst")).distinct(), ["bid_id", "dst"], "left_semi").select("bid_id", "src", "dst")


def dossiers(bids: DataFrame, results: DataFrame, facts: DataFrame, findings: DataFrame, checks: DataFrame, queue: DataFrame) -> DataFrame:
    """One row a bid: its results, facts, findings, registry checks and review items nested, each in order; what a bid has none of is empty."""
    out = bids.select("bid_id", "tender_id")
    parts = {
        "results": (results, ("requirement_id", "status", "severity", "actual", "expected_value", "applicability")), "facts": (facts, ("field", "fact_seq", "value", "source_document", "page")),
        "findings": (findings.withColumn("finding_id", rollup.finding_id()), ("finding_id", "status", "finding_type", "value_a", "value_b")), "checks": (checks, ("registry", "status", "identifier", "holder")), "reviews": (queue, ("source_order", "related", "category", "severity")),
    }
    for name, (df, columns) in parts.items():
        nested = df.groupBy("bid_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(nested, "bid_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, id): ids on one side alone."""
    a, b = left.select("id").distinct(), right.select("id").distinct()
    return a.join(b, "id", "left_anti").select(F.lit("left_only").alias("side"), "id").unionByName(b.join(a, "id", "left_anti").select(F.lit("right_only").alias("side"), "id"))


def config_hash(config: dict[str, str]) -> Column:
    """The SHA-256 of a configuration as JSON with sorted keys."""
    return F.sha2(F.lit(json.dumps(config, separators=(",", ":"), sort_keys=True)), 256)


def snapshots(results: DataFrame, config: dict[str, str]) -> DataFrame:
    """An order-independent hash of each bid's results, and that of the configuration; times are not part of them."""
    lines = F.sort_array(F.collect_list(F.concat_ws(":", "requirement_id", "status", "severity")))
    return results.groupBy("bid_id").agg(F.sha2(F.array_join(lines, ";"), 256).alias("snapshot_hash")).withColumn("config_hash", config_hash(config))


def snapshot_records(bids: DataFrame, results: DataFrame, facts: DataFrame) -> DataFrame:
    """Snapshots as nested records: versions, ids, requirements, facts, hash."""
    r = results.groupBy("bid_id").agg(F.sort_array(F.collect_list(F.struct("requirement_id", "operator"))).alias("requirements"))
    f = facts.groupBy("bid_id").agg(F.sort_array(F.collect_list(F.struct(F.concat_ws("-", "field", "fact_seq").alias("fact_id"), "field", "source_document"))).alias("bidder_facts"))
    return bids.select("bid_id", "tender_id").join(r, "bid_id").join(f, "bid_id").withColumn("snapshot_version", F.lit(SNAPSHOT_VERSIONS[0])).join(snapshots(results, {}), "bid_id")


def snapshot_errors(records: DataFrame) -> DataFrame:
    """``records`` with ``errors``; where a required part lacks, that alone is told."""
    required = ("snapshot_version", "tender_id", "bid_id", "requirements", "bidder_facts", "snapshot_hash")
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    without = lambda c, what, part: F.when(F.size(F.filter(c, lambda x: blank(x[part]))) > 0, F.concat_ws(" ", F.size(F.filter(c, lambda x: blank(x[part]))).cast("string"), F.lit(f"{what} without {part}")))
    faults = F.array_compact(F.array(
        F.when(~F.col("snapshot_version").isin(*SNAPSHOT_VERSIONS), F.concat(F.lit("unsupported version "), "snapshot_version")),
        F.when(blank(F.col("bid_id").cast("string")), "empty bid_id"), F.when(blank(F.col("tender_id")), "empty tender_id"),
        without("requirements", "requirements", "requirement_id"), without("requirements", "requirements", "operator"),
        without("bidder_facts", "facts", "fact_id"), without("bidder_facts", "facts", "field"), without("bidder_facts", "facts", "source_document"),
    ))
    return records.withColumn("errors", F.when(F.size(lacking) > 0, lacking).otherwise(faults))


def decisions(events: DataFrame) -> DataFrame:
    """(target, decision, ts, event_id): valid officer decisions among events."""
    named = F.element_at(F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair]), F.col("event_type"))
    return events.select(F.col("user_id").alias("target"), F.when(F.col("event_type").isin(*DECISIONS), named).alias("decision"), "ts", "event_id").filter("decision is not null")


def latest_overrides(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("target").agg(F.max_by(F.struct("decision", "event_id"), F.struct("ts", "event_id")).alias("x")).select("target", "x.*")


def trail(decisions: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("ts", "event_id", "decision")))
    return decisions.groupBy("target").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["decision"]), ",").alias("trail"))
