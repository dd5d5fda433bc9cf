"""Queries of evaluation, windows, limits, set operations, provenance, snapshots and streams."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.operators import adjudication, audit, evaluate, graph, registry, replay, resolve, rollup, text
from attestra.sources import bridge, files, tables

from . import compliance_queries as base
from . import oracle
from .registered import Registered


OWN = Registered()
register = OWN.register


_PREDICTED = "CASE compliance_status WHEN 'PASS' THEN 'PASS' WHEN 'FAIL' THEN 'FAIL' ELSE 'REVIEW' END"
oracle.view("labelled", f"SELECT b.bid_id, b.tender_id, truth, {_PREDICTED} AS predicted, c.total, c.missing, o.review_required FROM bids b JOIN compliance c ON b.bid_id = c.bid_id JOIN (SELECT bid_id, review_required FROM overall) o ON b.bid_id = o.bid_id", "bids", "compliance", "overall")


def labelled(spark, sf_dir):
    predicted = rollup.overall(base.tally(spark, sf_dir)).withColumn("predicted", F.expr(_PREDICTED))
    return bridge.bids(spark, sf_dir).join(predicted, "bid_id").select("bid_id", "tender_id", "truth", "predicted", "total", "missing", "review_required")


@register("c18_label_join", oracle.sql("SELECT bid_id, truth, predicted, truth = predicted AS agrees FROM labelled", "labelled"))
def _labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("bid_id", "truth", "predicted", (F.col("truth") == F.col("predicted")).alias("agrees"))


@register("d08_confusion_matrix", oracle.sql("SELECT truth, count(*) FILTER (predicted = 'PASS') AS \"PASS\", count(*) FILTER (predicted = 'FAIL') AS \"FAIL\", count(*) FILTER (predicted = 'REVIEW') AS \"REVIEW\" FROM labelled GROUP BY truth", "labelled"))
def _confusion(spark, sf_dir):
    return evaluate.confusion(labelled(spark, sf_dir), "truth", "predicted", ["PASS", "FAIL", "REVIEW"])


_RATES = """SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / nullif(n, 0), 6) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity,
round(false_pass::DOUBLE / nullif(n_fail, 0), 6) AS false_pass_rate, round(false_fail::DOUBLE / nullif(n_pass, 0), 6) AS false_fail_rate, round(abstained::DOUBLE / nullif(n, 0), 6) AS abstention_rate, round(escaped::DOUBLE / nullif(abstained, 0), 6) AS review_escape_rate,
round(greatest(0.0::DOUBLE, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 4) AS low, round(least(1.0::DOUBLE, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 4) AS high
FROM (SELECT *, (tp + tn)::DOUBLE / nullif(n, 0) AS p, 1.959963984540054::DOUBLE AS z FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (truth = 'PASS' AND predicted = 'PASS') AS tp, count(*) FILTER (truth <> 'PASS' AND predicted = 'PASS') AS fp, count(*) FILTER (truth = 'PASS' AND predicted <> 'PASS') AS fn, count(*) FILTER (truth <> 'PASS' AND predicted <> 'PASS') AS tn,
count(*) FILTER (truth = 'FAIL' AND predicted = 'PASS') AS false_pass, count(*) FILTER (truth = 'PASS' AND predicted = 'FAIL') AS false_fail, count(*) FILTER (truth = 'FAIL') AS n_fail, count(*) FILTER (truth = 'PASS') AS n_pass, count(*) FILTER (predicted = 'REVIEW') AS abstained, count(*) FILTER (predicted = 'REVIEW' AND NOT review_required) AS escaped FROM labelled))"""


@register("d09_rates", oracle.sql(_RATES, "labelled"))
def _rates(spark, sf_dir):
    return evaluate.rates(labelled(spark, sf_dir))


@register("d10_by_field", oracle.sql("SELECT field, count(*) AS support, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, round(count(*) FILTER (status = 'PASS')::DOUBLE / count(*), 6) AS pass_rate FROM results WHERE basis = 'EVALUATED' GROUP BY field", "results"))
def _by_field(spark, sf_dir):
    r = base.results(spark, sf_dir).filter("basis = 'EVALUATED'").groupBy("field").agg(F.count("*").alias("support"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"))
    return r.withColumn("pass_rate", F.round(F.col("passed") / F.col("support"), 6))


@register("d11_bids_by_difficulty", oracle.sql("SELECT CASE WHEN missing > 2 THEN 'HARD' WHEN missing > 1 THEN 'MEDIUM' ELSE 'EASY' END AS bucket, truth, count(*) AS n, count(*) FILTER (CASE WHEN truth = 'PASS' THEN predicted = 'PASS' ELSE predicted <> 'PASS' END) AS correct FROM labelled GROUP BY ALL", "labelled"))
def _difficulty(spark, sf_dir):
    bucket = F.when(F.col("missing") > 2, "HARD").when(F.col("missing") > 1, "MEDIUM").otherwise("EASY")
    right = F.when(F.col("truth") == "PASS", F.col("predicted") == "PASS").otherwise(F.col("predicted") != "PASS")
    return labelled(spark, sf_dir).groupBy(bucket.alias("bucket"), "truth").agg(F.count("*").alias("n"), F.count_if(right).alias("correct"))


@register("d12_contradictions_by_type", oracle.sql("SELECT field, count(*) AS pairs, count(*) FILTER (status = 'CONTRADICTION') AS detected, round(count(*) FILTER (status = 'CONTRADICTION')::DOUBLE / count(*), 6) AS share FROM pairs GROUP BY field", "pairs"))
def _by_type(spark, sf_dir):
    p = base.pairs_in_passing(spark, sf_dir).groupBy("field").agg(F.count("*").alias("pairs"), F.count_if(F.col("status") == "CONTRADICTION").alias("detected"))
    return p.withColumn("share", F.round(F.col("detected") / F.col("pairs"), 6))


# Labelled contradictions: what each pair of lines of a bid should be found to be, from the lines themselves.
_LABELLED = """SELECT a.bid_id, f AS raw_field, a.line_no AS seq_a, b.line_no AS seq_b, CASE f WHEN 'gstin' THEN CASE WHEN a.l_suppkey = b.l_suppkey THEN 'CONSISTENT_GSTIN' ELSE 'GSTIN_CONTRADICTION' END WHEN 'warranty_years' THEN CASE WHEN a.l_partkey % 5 = b.l_partkey % 5 THEN 'CONSISTENT_DURATION' ELSE 'WARRANTY_CONTRADICTION' END ELSE CASE WHEN CAST(a.l_quantity AS INT) % 5 = CAST(b.l_quantity AS INT) % 5 THEN 'CONSISTENT_TURNOVER' ELSE 'TURNOVER_CONTRADICTION' END END AS label
FROM {0} a JOIN {0} b ON a.bid_id = b.bid_id AND a.line_no < b.line_no, (VALUES ('gstin'), ('warranty_years'), ('turnover_cr')) v(f)"""
oracle.view("labelled_pairs", _LABELLED.format("lines"), "lines")


@register("d12_exact_matches", oracle.sql("SELECT label, count(*) AS pairs, count(*) FILTER (status = 'CONTRADICTION') AS detected, count(*) FILTER (finding_type = label) AS exact, round(count(*) FILTER (finding_type = label)::DOUBLE / count(*), 6) AS exact_rate FROM labelled_pairs l LEFT JOIN pairs p ON p.bid_id = l.bid_id AND p.raw_field_a = l.raw_field AND p.raw_field_b = l.raw_field AND p.seq_a = l.seq_a AND p.seq_b = l.seq_b GROUP BY label", "labelled_pairs", "pairs"))
def _exact_contradictions(spark, sf_dir):
    labels = spark.sql(_LABELLED.format("{lines}"), lines=bridge.lines(spark, sf_dir))
    found = base.pairs_in_passing(spark, sf_dir).filter("raw_field_a = raw_field_b").select("bid_id", F.col("raw_field_a").alias("raw_field"), "seq_a", "seq_b", "status", "finding_type")
    return evaluate.exact_matches(labels, found, ["bid_id", "raw_field", "seq_a", "seq_b"])


@register("d13_grouping_sets", "SELECT event_type, user_id % 7 AS team, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 7), ())")
def _sets(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events").withColumn("team", F.col("user_id") % 7)
    return e.groupingSets([[F.col("event_type")], [F.col("team")], []], F.col("event_type"), F.col("team")).agg(F.count("*").alias("n"))


@register("d14_error_taxonomy", oracle.sql("SELECT category, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN predicted = 'REVIEW' THEN 'ABSTAINED' WHEN predicted = 'PASS' THEN 'FALSE_PASS' WHEN truth = 'PASS' THEN 'FALSE_FAIL' ELSE 'LABEL_UNCERTAIN' END AS category, count(*) AS n FROM labelled WHERE truth <> predicted GROUP BY ALL)", "labelled"))
def _taxonomy(spark, sf_dir):
    kind = F.when(F.col("predicted") == "REVIEW", "ABSTAINED").when(F.col("predicted") == "PASS", "FALSE_PASS").when(F.col("truth") == "PASS", "FALSE_FAIL").otherwise("LABEL_UNCERTAIN")
    n = labelled(spark, sf_dir).filter("truth <> predicted").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row for each category


@register("d16_corpus_summary", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_long, round(avg(CASE WHEN n_chars > 1000 THEN n_chars END), 4) AS mean_long FROM documents GROUP BY lang")
def _summary(spark, sf_dir):
    long = F.col("n_chars") > 1000
    return bridge.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(long).alias("n_long"), F.round(F.avg(F.when(long, F.col("n_chars"))), 4).alias("mean_long"))


@register("d17_filings_by_type", "SELECT user_id, CAST(sum(n) AS BIGINT) AS total, string_agg(event_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY event_type) AS by_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def _filings(spark, sf_dir):
    n = bridge.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "event_type", "n"))), ",")
    return n.groupBy("user_id").agg(F.sum("n").alias("total"), listed.alias("by_type"))


@register("d18_dashboard_counters", oracle.sql("SELECT tender_id, count(*) AS n, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (requires_review) AS open_items FROM results GROUP BY tender_id", "results"))
def _counters(spark, sf_dir):
    return base.results(spark, sf_dir).groupBy("tender_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if("requires_review").alias("open_items"))


@register("d19_detection_summary", "SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS detected, round(count(*) FILTER (toxic = 1)::DOUBLE / count(*), 6) AS rate FROM labels GROUP BY quality")
def _detections(spark, sf_dir):
    return bridge.table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("detected"), F.round(F.count_if(F.col("toxic") == 1) / F.count("*"), 6).alias("rate"))


@register("d20_safety_gates", oracle.sql("SELECT bool_and(NOT (basis = 'ABSENT' AND status = 'PASS')) AS missing_never_passes, bool_and(NOT (basis = 'SUPERSEDED' AND status <> 'N/A')) AS superseded_is_na, bool_and(NOT (status = 'FAIL' AND mandatory AND severity <> 'CRITICAL')) AS mandatory_is_critical FROM results", "results"))
def _gates(spark, sf_dir):
    c = F.col
    return base.results(spark, sf_dir).agg(F.bool_and(~((c("basis") == "ABSENT") & (c("status") == "PASS"))).alias("missing_never_passes"), F.bool_and(~((c("basis") == "SUPERSEDED") & (c("status") != "N/A"))).alias("superseded_is_na"), F.bool_and(~((c("status") == "FAIL") & c("mandatory") & (c("severity") != "CRITICAL"))).alias("mandatory_is_critical"))


@register("d21_evidence_counts", oracle.sql("SELECT bid_id, count(source_document) AS n, count(DISTINCT CASE WHEN source_document IS NOT NULL THEN source_document || ':' || CAST(page AS VARCHAR) END) AS pages, array_to_string(list_sort(list(DISTINCT source_document) FILTER (source_document IS NOT NULL)), ',') AS documents FROM results GROUP BY bid_id", "results"))
def _evidence(spark, sf_dir):
    page = F.when(F.col("source_document").isNotNull(), F.concat_ws(":", "source_document", "page"))
    return base.results(spark, sf_dir).groupBy("bid_id").agg(F.count("source_document").alias("n"), F.countDistinct(page).alias("pages"), F.array_join(F.sort_array(F.collect_set("source_document")), ",").alias("documents"))


def dossiers(spark, sf_dir, results=None, only=None):
    """The dossiers of all bids, or of those of ``only`` (bid_id): then nothing of other bids is dealt out and nested."""
    parts = [bridge.bids(spark, sf_dir), results or base.results(spark, sf_dir), bridge.facts(spark, sf_dir), base.findings(spark, sf_dir), base.checks(spark, sf_dir), base.queue(spark, sf_dir)]
    return audit.dossiers(*[df if only is None else df.join(only, "bid_id", "left_semi") for df in parts])


# Each nested part of a dossier as lines: table, what a line says, in which order.
_NESTED = {
    "results": ("results", ("requirement_id", "status", "severity"), "requirement_id"), "facts": ("facts", ("field", "value", "source_document", "page"), "field, fact_seq"), "findings": ("findings", ("finding_id", "status"), "finding_id"),
    "checks": ("checks", ("registry", "status"), "registry"), "reviews": ("queue", ("source_order", "related", "severity"), "source_order, related"),
}
_LINES = lambda columns: " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


@register("d22_dossiers", oracle.sql("SELECT b.bid_id, b.tender_id, " + ", ".join(f"coalesce({n}, '') AS {n}" for n in _NESTED) + " FROM bids b " + " ".join(f"LEFT JOIN (SELECT bid_id, string_agg({_LINES(columns)}, ';' ORDER BY {order}) AS {n} FROM {t} GROUP BY bid_id) {n}_of USING (bid_id)" for n, (t, columns, order) in _NESTED.items()), "bids", "results", "facts", "findings", "checks", "queue"))
def _dossiers(spark, sf_dir):
    told = lambda name, columns: F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[x[c].cast("string") for c in columns])), ";").alias(name)
    return dossiers(spark, sf_dir).select("bid_id", "tender_id", *[told(n, columns) for n, (_, columns, _) in _NESTED.items()])


@register("d24_completeness", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (trim(coalesce(CAST({c} AS VARCHAR), '')) <> '') AS filled FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def _completeness(spark, sf_dir):
    return evaluate.completeness(bridge.table(spark, sf_dir, "customer"))


@register("h26_wilson", "SELECT user_id, round(greatest(0.0::DOUBLE, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 4) AS low, round(least(1.0::DOUBLE, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 4) AS high FROM (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS p, 1.959963984540054::DOUBLE AS z FROM events GROUP BY user_id)")
def _wilson(spark, sf_dir):
    n = bridge.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return n.select("user_id", low.alias("low"), high.alias("high"))


# --- windows and limits --------------------------------------------------------------------


@register("e06_first_of_key", "SELECT bid_key, event_type, event_id FROM (SELECT user_id % 50 AS bid_key, event_type, event_id, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def _first_of_key(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("bid_key"), "event_type").agg(F.min("event_id").alias("event_id"))


# Versions of each page's text: what the file holds (pass 0), and what two passes of a recogniser made of it.
_PAGES = "SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY position) AS text FROM blocks GROUP BY ALL"
_VERSIONS = """SELECT doc_id, page_number, 0 AS pass, CASE (doc_id + page_number) % 4 WHEN 0 THEN '' WHEN 1 THEN substring(text, 1, 15) ELSE text END AS text, CAST(NULL AS DOUBLE) AS sure, true AS success FROM {0}
UNION ALL SELECT doc_id, page_number, 1, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' tender') ELSE substring(text, 1, CAST(length(text) / 2 AS INT)) END, (doc_id % 10) / 10.0, doc_id % 11 <> 0 FROM {0}
UNION ALL SELECT doc_id, page_number, 2, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' tender') ELSE text END, CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 ELSE page_number % 10 END / 10.0, doc_id % 13 <> 0 FROM {0}"""
oracle.view("doc_pages", _PAGES, "blocks")
oracle.view("versions", _VERSIONS.format("doc_pages").replace("length(text) / 2", "length(text) // 2").replace("/ 10.0", "/ 10.0::DOUBLE"), "doc_pages")


def page_versions(spark, sf_dir):
    lines = F.sort_array(F.collect_list(F.struct("position", "text")))
    pages = bridge.blocks(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))  # ten blocks a page
    return spark.sql(_VERSIONS.format("{pages}").replace("length(text) / 2", "length(text) div 2"), pages=pages).withColumn("sure", F.col("sure").cast("double"))


_SCORED = oracle.validated("(SELECT CAST(doc_id AS VARCHAR) || '/' || CAST(page_number AS VARCHAR) || '/' || CAST(pass AS VARCHAR) AS block_id, doc_id, text, greatest(0.1::DOUBLE, least(1.0::DOUBLE, coalesce(sure, 0))) AS sure_of, page_number, pass, success FROM versions)")
oracle.view("scored_versions", f"SELECT s.*, length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) AS n FROM ({_SCORED}) s", "versions")
_WEAK = "(v0.n < 20)"
oracle.view(
    "best_versions",
    f"""SELECT doc_id, page_number, CASE WHEN taken THEN pass ELSE 0 END AS pass, CASE WHEN taken THEN 'OCR' ELSE 'NATIVE_PDF' END AS method, CASE WHEN taken THEN n ELSE n0 END AS n_chars, CASE WHEN taken THEN score END AS score FROM (
SELECT v0.doc_id, v0.page_number, v0.n AS n0, b.pass, b.n, b.score, b.pass IS NOT NULL AND (b.n > v0.n OR {_WEAK}) AS taken FROM scored_versions v0 LEFT JOIN (SELECT doc_id, page_number, x.pass AS pass, x.n AS n, x.score AS score FROM (SELECT doc_id, page_number, max_by(struct_pack(pass := pass, n := n, score := composite), struct_pack(s := composite, p := -pass)) AS x FROM scored_versions WHERE pass > 0 AND success AND validity <> 'FAILED' GROUP BY ALL)) b ON b.doc_id = v0.doc_id AND b.page_number = v0.page_number WHERE v0.pass = 0)""",
    "scored_versions",
)


@register("e07_best_version", oracle.sql("SELECT doc_id, page_number, pass, method, n_chars, score FROM best_versions", "best_versions"))
def _best(spark, sf_dir):
    return text.best_version(page_versions(spark, sf_dir)).select("doc_id", "page_number", "pass", "method", "n_chars", "score")


@register("d15_document_rollup", oracle.sql("SELECT doc_id, count(*) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS n_chars, CASE WHEN bool_and(method = 'OCR') THEN 'OCR' WHEN bool_or(method = 'OCR') THEN 'HYBRID' ELSE 'NATIVE_PDF' END AS method, CASE WHEN bool_or(confidence = 'LOW') THEN 'LOW' WHEN bool_or(confidence = 'MEDIUM') THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM (SELECT *, CASE WHEN n_chars < 20 THEN 'LOW' WHEN n_chars < 80 THEN 'MEDIUM' WHEN method = 'NATIVE_PDF' THEN 'HIGH' WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM best_versions) GROUP BY doc_id", "best_versions"))
def _documents(spark, sf_dir):
    return text.document_rollup(text.best_version(page_versions(spark, sf_dir)))


_DECISION = "CASE event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'signup' THEN 'WAIVE' WHEN 'error' THEN 'CONFIRM_FAIL' WHEN 'click' THEN 'DISMISS' END"


@register("e08_latest_override", f"SELECT user_id AS target, decision FROM (SELECT user_id, {_DECISION} AS decision, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE {_DECISION} IS NOT NULL) WHERE r = 1")
def _latest(spark, sf_dir):
    return audit.latest_overrides(audit.decisions(bridge.table(spark, sf_dir, "events"))).select("target", "decision")


@register("f01_top_documents", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 ORDER BY n_chars DESC, doc_id LIMIT 10")
def _top(spark, sf_dir):
    return bridge.table(spark, sf_dir, "documents").filter("n_chars > 0").orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "n_chars").limit(10)


@register("f02_first_failures", oracle.sql("SELECT category, bid_id, requirement_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY bid_id, requirement_id) AS r FROM results WHERE status = 'FAIL') WHERE r <= 5", "results"))
def _failures(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("category").orderBy("bid_id", "requirement_id"))
    return base.results(spark, sf_dir).filter("status = 'FAIL'").withColumn("r", r).filter("r <= 5").select("category", "bid_id", "requirement_id")


@register("f03_last_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def _last_events(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type").limit(20)


@register("f04_category_frequency", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def _frequency(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@register("f05_sorted_serialization", oracle.sql("SELECT bid_id, string_agg(field || '=' || value, '|' ORDER BY field) AS line FROM last_facts GROUP BY bid_id", "last_facts"))
def _sorted(spark, sf_dir):
    known = base.profiles(spark, sf_dir)  # a row a bid, whose fields are columns
    stated = [F.concat(F.lit(f"{f}="), F.col(f"{f}.last.value")) for f in sorted(known.columns) if f != "bid_id"]
    return known.select("bid_id", F.concat_ws("|", *stated).alias("line")).filter("line <> ''")


@register("f06_queue_page", "SELECT event_id, event_type FROM events ORDER BY event_type, event_id LIMIT 25 OFFSET 50")
def _page(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").select("event_id", "event_type").orderBy("event_type", "event_id").offset(50).limit(25)


# --- set operations ------------------------------------------------------------------------


@register("g01_two_passes", "SELECT conv_id, turn, 1 AS pass FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 2 FROM conversations WHERE role IS DISTINCT FROM 'user'")
def _passes(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "conversations")
    asked = F.coalesce(F.col("role") == "user", F.lit(False))
    one, two = (c.filter(kept).select("conv_id", "turn", F.lit(k).alias("pass")) for k, kept in ((1, asked), (2, ~asked)))
    return one.unionByName(two)


@register("g02_findings_and_anomalies", oracle.sql("SELECT bid_id, finding_type, 'FINDING' AS origin FROM findings UNION ALL SELECT user_id, upper(event_type), 'ANOMALY' FROM events WHERE event_type NOT IN ('view', 'click')", "findings"))
def _anomalies(spark, sf_dir):
    f = base.findings(spark, sf_dir).select("bid_id", "finding_type", F.lit("FINDING").alias("origin"))
    e = bridge.table(spark, sf_dir, "events").filter(~F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("bid_id"), F.upper("event_type").alias("finding_type"), F.lit("ANOMALY").alias("origin"))
    return f.unionByName(e)


@register("g05_id_differences", "SELECT side, id FROM (SELECT 'left_only' AS side, o_custkey AS id FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'right_only', c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders))")
def _differences(spark, sf_dir):
    return audit.differences(bridge.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), bridge.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@register("g06_declared_not_checked", oracle.sql("SELECT DISTINCT 'not_registered' AS side, value AS identifier FROM facts WHERE field = 'gstin' AND value NOT IN (SELECT key FROM registry WHERE registry = 'GST') UNION ALL SELECT DISTINCT 'not_declared', key FROM registry WHERE registry = 'GST' AND key NOT IN (SELECT value FROM facts WHERE field = 'gstin')", "facts", "registry"))
def _undeclared(spark, sf_dir):
    declared = bridge.facts(spark, sf_dir, ("gstin",)).select(F.col("value").alias("id"))
    registered = bridge.registry(spark, sf_dir).filter("registry = 'GST'").select(F.col("key").alias("id"))
    side = F.when(F.col("side") == "left_only", "not_registered").otherwise("not_declared")
    return audit.differences(declared, registered).select(side.alias("side"), F.col("id").alias("identifier"))


_CLASSES = "CASE registry WHEN 'OEM' THEN 'AUTHORIZATION' WHEN 'MII' THEN 'DECLARATION' WHEN 'ITD' THEN 'RETURN' ELSE 'REGULATORY' END"
_DECLARED_CLASS = "CASE " + " ".join(f"WHEN coalesce(canonical, '') IN {oracle._list((*canonical, '?'))} OR lower(field) IN {oracle._list(fields)} THEN '{kind}'" for kind, (canonical, fields) in registry.DECLARED.items()) + " END"
oracle.view("declared_ids", f"SELECT DISTINCT bid_id, class, upper(trim(value)) AS id FROM (SELECT bid_id, value, {_DECLARED_CLASS} AS class FROM facts JOIN canon USING (field)) WHERE class IS NOT NULL AND trim(value) <> ''", "facts", "canon")
oracle.view("captured_ids", f"SELECT DISTINCT bid_id, registry, {_CLASSES} AS class, upper(trim(identifier)) AS id FROM checks WHERE trim(coalesce(identifier, '')) <> ''", "checks")


@register("g06_identifier_classes", oracle.sql("SELECT 'NOT_CHECKED' AS side, bid_id, class, id FROM declared_ids d WHERE class = 'REGULATORY' AND NOT EXISTS (SELECT 1 FROM captured_ids c WHERE c.bid_id = d.bid_id AND c.id = d.id) UNION ALL SELECT DISTINCT 'NOT_DECLARED', bid_id, class, id FROM captured_ids c WHERE EXISTS (SELECT 1 FROM declared_ids d WHERE d.bid_id = c.bid_id AND d.class = c.class) AND NOT EXISTS (SELECT 1 FROM declared_ids d WHERE d.bid_id = c.bid_id AND d.class = c.class AND d.id = c.id)", "declared_ids", "captured_ids"))
def _identifier_classes(spark, sf_dir):
    """By bid and class: identifiers that a bid declares and no registry was asked for, and those that one was asked for and the bid does not declare."""
    return registry.undeclared(bridge.facts(spark, sf_dir), base.checks(spark, sf_dir))


@register("g07_block_sets", "SELECT conv_id, array_to_string(list_transform(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), lambda x: CAST(x AS VARCHAR)), ',') AS joined, list_has_any(coalesce(a, []), coalesce(b, [])) AS overlap, list_sort(list_distinct(coalesce(a, []))) = list_sort(list_distinct(coalesce(b, []))) AS same FROM (SELECT conv_id, list(turn) FILTER (role = 'user') AS a, list(turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)")
def _block_sets(spark, sf_dir):
    side = lambda r: F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("turn"))))
    g = bridge.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("user").alias("a"), side("assistant").alias("b"))
    return g.select("conv_id", F.array_join(F.transform(F.sort_array(F.array_union("a", "b")), lambda x: x.cast("string")), ",").alias("joined"), F.arrays_overlap("a", "b").alias("overlap"), (F.col("a") == F.col("b")).alias("same"))


# --- provenance ----------------------------------------------------------------------------

_BLOCK = "'BLOCK:' || source_document || ':' || CAST(page AS VARCHAR)"
_FACT = "'FACT:' || {0} || '-' || CAST({1} AS VARCHAR)"
oracle.view("decided_events", f"SELECT user_id AS target, event_id, decision FROM (SELECT user_id, event_id, {_DECISION} AS decision, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE {_DECISION} IS NOT NULL) WHERE r = 1")
oracle.view(
    "edges",
    f"""SELECT DISTINCT * FROM (
SELECT bid_id, 'REQ:' || requirement_id AS src, 'BLOCK:' || tender_id || '.pdf:1' AS dst, 'REQUIREMENT_HAS_EVIDENCE' AS kind FROM results
UNION ALL SELECT bid_id, {_FACT.format('raw', 'fact_seq')}, {_BLOCK}, 'FACT_GROUNDED_BY' FROM grouped
UNION ALL SELECT g.bid_id, {_FACT.format('raw', 'fact_seq')}, 'FIELD:' || c.canonical, 'FACT_CANONICALIZED_AS' FROM grouped g JOIN canon c ON g.raw = c.field WHERE c.canonical IS NOT NULL
UNION ALL SELECT bid_id, 'RESULT:' || requirement_id, 'REQ:' || requirement_id, 'RESULT_EVALUATES_REQUIREMENT' FROM results
UNION ALL SELECT r.bid_id, 'RESULT:' || requirement_id, {_FACT.format('f.raw', 'f.fact_seq')}, 'RESULT_EVALUATES_FACT' FROM results r JOIN grouped f ON r.bid_id = f.bid_id AND r.actual = f.value AND r.source_document = f.source_document AND r.page = f.page AND (lower(r.field) = f.raw OR r.canonical = f.field) WHERE r.basis = 'EVALUATED'
UNION ALL SELECT r.bid_id, {_FACT.format('f.raw', 'f.fact_seq')}, 'REQ:' || requirement_id, 'FACT_SATISFIES_REQUIREMENT' FROM results r JOIN grouped f ON r.bid_id = f.bid_id AND r.actual = f.value AND r.source_document = f.source_document AND r.page = f.page AND (lower(r.field) = f.raw OR r.canonical = f.field) WHERE r.basis = 'EVALUATED' AND r.status IN ('PASS', 'PARTIAL')
UNION ALL SELECT bid_id, 'RESULT:' || requirement_id, {_BLOCK}, 'RESULT_SUPPORTED_BY' FROM results WHERE basis = 'EVALUATED'
UNION ALL SELECT bid_id, 'INTEGRITY:' || finding_id, 'BLOCK:' || document_a || ':' || CAST(page_a AS VARCHAR), 'RESULT_SUPPORTED_BY' FROM findings
UNION ALL SELECT bid_id, 'INTEGRITY:' || finding_id, 'BLOCK:' || document_b || ':' || CAST(page_b AS VARCHAR), 'RESULT_SUPPORTED_BY' FROM findings
UNION ALL SELECT bid_id, 'INTEGRITY:' || finding_id, {_FACT.format('raw_field_a', 'seq_a')}, 'INTEGRITY_FINDING_COMPARES' FROM findings
UNION ALL SELECT bid_id, 'INTEGRITY:' || finding_id, {_FACT.format('raw_field_b', 'seq_b')}, 'INTEGRITY_FINDING_COMPARES' FROM findings
UNION ALL SELECT r.bid_id, 'RESULT:' || requirement_id, 'INTEGRITY:' || finding_id, 'RESULT_AFFECTED_BY_INTEGRITY' FROM results r JOIN findings f ON r.bid_id = f.bid_id AND (r.canonical = f.field OR lower(r.field) IN (lower(f.field), f.raw_field_a, f.raw_field_b))
UNION ALL SELECT bid_id, 'REVIEW:' || related, CASE source_order WHEN 1 THEN 'RESULT:' ELSE 'INTEGRITY:' END || related, 'REVIEW_ITEM_FOR_RESULT' FROM queue WHERE source_order <= 2
UNION ALL SELECT q.bid_id, 'REVIEW:' || related, 'BLOCK:' || source_document || ':' || CAST(page AS VARCHAR), 'REVIEW_ITEM_SUPPORTED_BY' FROM queue q JOIN results r ON q.bid_id = r.bid_id AND q.related = r.requirement_id WHERE source_order = 1 AND source_document IS NOT NULL
UNION ALL SELECT bid_id, 'ADJUDICATION:' || CAST(event_id AS VARCHAR), 'RESULT:' || requirement_id, 'ADJUDICATION_OVERRIDES_RESULT' FROM results JOIN decided_events ON target = bid_id WHERE rank = 1 AND field = 'turnover_cr'
UNION ALL SELECT r.bid_id, 'ADJUDICATION:' || CAST(event_id AS VARCHAR), 'REVIEW:' || related, 'ADJUDICATION_FOR_REVIEW_ITEM' FROM queue r JOIN decided_events ON target = r.bid_id JOIN results x ON x.bid_id = r.bid_id AND x.requirement_id = r.related AND x.rank = 1 AND x.field = 'turnover_cr' WHERE source_order = 1
UNION ALL SELECT bid_id, 'FACT:' || lower(registry) || '.' || d.field, 'BLOCK:' || registry || ':' || coalesce(identifier, ''), 'FACT_GROUNDED_BY' FROM (SELECT bid_id, registry, identifier, unnest(details) AS d FROM checks WHERE status = 'VERIFIED') WHERE d.value IS NOT NULL)""",
    "results", "grouped", "canon", "findings", "queue", "decided_events", "checks",
)
oracle.view(
    "nodes",
    f"""SELECT DISTINCT * FROM (
SELECT bid_id, 'REQ:' || requirement_id AS id, 'TENDER_REQUIREMENT' AS node_type FROM bids JOIN reqs USING (tender_id)
UNION ALL SELECT bid_id, 'BLOCK:' || tender_id || '.pdf:1', 'PHYSICAL_TEXT_BLOCK' FROM bids
UNION ALL SELECT bid_id, 'BLOCK:D' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(line_no AS VARCHAR), 'PHYSICAL_TEXT_BLOCK' FROM lines
UNION ALL SELECT bid_id, 'BLOCK:' || registry || ':' || coalesce(identifier, ''), 'PHYSICAL_TEXT_BLOCK' FROM checks WHERE status = 'VERIFIED'
UNION ALL SELECT bid_id, {_FACT.format('field', 'fact_seq')}, 'BIDDER_FACT' FROM facts
UNION ALL SELECT bid_id, 'FACT:' || lower(registry) || '.' || d.field, 'BIDDER_FACT' FROM (SELECT bid_id, registry, unnest(details) AS d FROM checks WHERE status = 'VERIFIED') WHERE d.value IS NOT NULL
UNION ALL SELECT bid_id, 'FIELD:' || canonical, 'CANONICAL_FIELD' FROM facts JOIN canon USING (field) WHERE canonical IS NOT NULL
UNION ALL SELECT bid_id, 'RESULT:' || requirement_id, 'VERIFICATION_RESULT' FROM results
UNION ALL SELECT bid_id, 'INTEGRITY:' || finding_id, 'INTEGRITY_FINDING' FROM findings
UNION ALL SELECT bid_id, 'REVIEW:' || related, 'HUMAN_REVIEW_ITEM' FROM queue
UNION ALL SELECT bid_id, 'ADJUDICATION:' || CAST(event_id AS VARCHAR), 'OFFICER_ADJUDICATION' FROM bids JOIN decided_events ON target = bid_id)""",
    "bids", "reqs", "lines", "checks", "facts", "canon", "results", "findings", "queue", "decided_events",
)


def _decided(spark, sf_dir):
    return audit.latest_overrides(audit.decisions(bridge.table(spark, sf_dir, "events")))


def _documents_of(spark, sf_dir):
    """(bid_id, source_document, page): the submitted pages."""
    return bridge.lines(spark, sf_dir).select("bid_id", F.concat(F.lit("D"), F.col("l_linenumber").cast("string")).alias("source_document"), F.col("line_no").alias("page"))


edges = base._once("edges", lambda s, d: audit.edges(base.results(s, d), bridge.facts(s, d), base.findings(s, d), base.queue(s, d), base.checks(s, d), _decided(s, d)))
nodes = base._once("nodes", lambda s, d: graph.nodes(bridge.bids(s, d), bridge.requirements(s), _documents_of(s, d), bridge.facts(s, d), base.results(s, d), base.findings(s, d), base.queue(s, d), _decided(s, d), base.checks(s, d)))

_PAGED = "SELECT bid_id, {0}, page, count(*) AS n, string_agg(line, ';' ORDER BY line) AS lines FROM (SELECT bid_id, {0}, {1} AS line, CAST((row_number() OVER (PARTITION BY bid_id, {0} ORDER BY {1}) - 1) // %d AS INT) AS page FROM {2}) GROUP BY ALL" % graph.PAGE


@register("i01_nodes", oracle.sql(_PAGED.format("node_type", "id", "nodes"), "nodes"))
def _nodes(spark, sf_dir):
    return graph.paged(nodes(spark, sf_dir), "node_type", F.col("id"))


@register("i02_edges", oracle.sql(_PAGED.format("kind", "(src || '>' || dst)", "edges"), "edges"))
def _edges(spark, sf_dir):
    return graph.paged(edges(spark, sf_dir), "kind", F.concat_ws(">", "src", "dst"))


#: A graph that is spoilt in each way that the checks can tell.
_LOST = "(id LIKE 'BLOCK:D1:%' AND bid_id % 7 = 0) OR (id LIKE 'RESULT:%R59' AND bid_id % 11 = 0)"
_SPOILT_NODES = f"SELECT bid_id, id, node_type FROM {{0}} WHERE NOT ({_LOST}) UNION ALL SELECT bid_id, id, 'GHOST' AS node_type FROM {{0}} WHERE node_type = 'CANONICAL_FIELD' AND bid_id % 13 = 0 UNION ALL SELECT bid_id, 'BLOCK:loose:1' AS id, node_type FROM {{0}} WHERE id LIKE 'BLOCK:%.pdf:1' AND bid_id % 19 = 0"
_SPOILT_EDGES = "SELECT bid_id, src, dst, kind FROM {0} UNION ALL SELECT bid_id, src, src AS dst, kind FROM {0} WHERE kind = 'REQUIREMENT_HAS_EVIDENCE' AND src LIKE 'REQ:%R51' AND bid_id % 5 = 0 UNION ALL SELECT bid_id, src, dst, 'MADE_UP' AS kind FROM {0} WHERE kind = 'REQUIREMENT_HAS_EVIDENCE' AND src LIKE 'REQ:%R52' AND bid_id % 17 = 0"
oracle.view("spoilt_nodes", _SPOILT_NODES.format("nodes"), "nodes")
oracle.view("spoilt_edges", _SPOILT_EDGES.format("edges"), "edges")
_ENDS = ", ".join(f"('{kind}', '{a}', '{b}')" for kind, (a, b) in graph.EDGE_TYPES.items())
_FAULTS = f"""SELECT bid_id, fault, id FROM (SELECT bid_id, src || ' > ' || e.kind || ' > ' || dst AS id, unnest(list_filter([CASE WHEN s.types IS NULL THEN 'DANGLING_SOURCE' END, CASE WHEN d.types IS NULL THEN 'DANGLING_TARGET' END, CASE WHEN src = dst THEN 'SELF_LOOP' END, CASE WHEN k.kind IS NULL THEN 'INVALID_EDGE_TYPE' END, CASE WHEN NOT list_has_any(s.types, string_split(k.a, ',')) OR NOT list_has_any(d.types, string_split(k.b, ',')) THEN 'INVALID_ENDS' END], lambda x: x IS NOT NULL)) AS fault
FROM {{1}} e LEFT JOIN {{2}} s ON s.b = e.bid_id AND s.i = src LEFT JOIN {{2}} d ON d.b = e.bid_id AND d.i = dst LEFT JOIN (VALUES {_ENDS}) k(kind, a, b) ON k.kind = e.kind)
UNION ALL SELECT b, 'TYPE_CONFLICT', i FROM {{2}} WHERE len(types) > 1 UNION ALL SELECT bid_id, 'INVALID_NODE_TYPE', id FROM {{0}} WHERE node_type NOT IN {oracle._list(graph.NODE_TYPES)}
UNION ALL SELECT b, 'ORPHAN_NODE', i FROM {{2}} t WHERE NOT EXISTS (SELECT 1 FROM {{1}} e WHERE e.bid_id = t.b AND e.src = t.i) AND NOT EXISTS (SELECT 1 FROM {{1}} e WHERE e.bid_id = t.b AND e.dst = t.i)"""
for _graph in ("", "spoilt_"):
    oracle.view(f"{_graph}types", f"SELECT bid_id AS b, id AS i, list(DISTINCT node_type) AS types FROM {_graph}nodes GROUP BY ALL", f"{_graph}nodes")
    oracle.view(f"{_graph}faults", _FAULTS.format(f"{_graph}nodes", f"{_graph}edges", f"{_graph}types"), f"{_graph}nodes", f"{_graph}edges", f"{_graph}types")


def _spoilt(spark, sf_dir):
    return spark.sql(_SPOILT_NODES.format("{n}"), n=nodes(spark, sf_dir)), spark.sql(_SPOILT_EDGES.format("{e}"), e=edges(spark, sf_dir))


@register("i03_structure", oracle.sql("SELECT graph, fault, count(*) AS n, count(DISTINCT bid_id) AS bids FROM (SELECT 'BUILT' AS graph, * FROM faults UNION ALL SELECT 'SPOILT', * FROM spoilt_faults) GROUP BY ALL", "faults", "spoilt_faults"))
def _structure(spark, sf_dir):
    built, spoilt = graph.faults(nodes(spark, sf_dir), edges(spark, sf_dir)), graph.faults(*_spoilt(spark, sf_dir))
    told = built.withColumn("graph", F.lit("BUILT")).unionByName(spoilt.withColumn("graph", F.lit("SPOILT")))
    return told.groupBy("graph", "fault").agg(F.count("*").alias("n"), F.countDistinct("bid_id").alias("bids"))


@register("i04_acyclicity", oracle.sql("WITH RECURSIVE tops AS (SELECT DISTINCT kind, split_part(src, ':', 1) AS a, split_part(dst, ':', 1) AS b FROM edges), reach AS (SELECT DISTINCT a, b FROM tops UNION SELECT r.a, t.b FROM reach r JOIN tops t ON r.b = t.a) SELECT bid_id, false AS cyclic FROM bids WHERE NOT EXISTS (SELECT 1 FROM reach WHERE a = b)".replace("WITH RECURSIVE tops", "SELECT * FROM (WITH RECURSIVE tops") + ")", "edges", "bids"))
def _acyclic(spark, sf_dir):
    cyclic = audit.cyclic_bids(edges(spark, sf_dir)).select("bid_id", F.lit(True).alias("cyclic"))
    return bridge.bids(spark, sf_dir).select("bid_id").join(cyclic, "bid_id", "left").select("bid_id", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


_REACH = "(WITH RECURSIVE reach AS (SELECT bid_id, id AS root, id, 0 AS depth FROM nodes WHERE node_type = '{0}' UNION SELECT r.bid_id, root, {2}, depth + 1 FROM reach r JOIN edges e ON r.bid_id = e.bid_id AND r.id = e.{1}) SELECT bid_id, root, id, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY ALL)"
oracle.view("rests_on", _REACH.format("VERIFICATION_RESULT", "src", "dst"), "nodes", "edges")
oracle.view("decides", _REACH.format("PHYSICAL_TEXT_BLOCK", "dst", "src"), "nodes", "edges")


@register("i05_trace_decisions", oracle.sql("SELECT r.bid_id, root AS result, r.id AS evidence, depth FROM rests_on r JOIN nodes n ON r.bid_id = n.bid_id AND r.id = n.id AND node_type = 'PHYSICAL_TEXT_BLOCK'", "rests_on", "nodes"))
def _trace(spark, sf_dir):
    return graph.evidence_of(nodes(spark, sf_dir), edges(spark, sf_dir))


@register("i06_evidence_to_decisions", oracle.sql(f"SELECT r.bid_id, root AS evidence, node_type, count(*) AS n, min(depth) AS nearest, max(depth) AS farthest, string_agg(r.id, ',' ORDER BY r.id) AS decisions FROM decides r JOIN nodes n ON r.bid_id = n.bid_id AND r.id = n.id AND node_type IN {oracle._list(graph.DECIDED)} GROUP BY ALL", "decides", "nodes"))
def _back(spark, sf_dir):
    found = graph.decisions_on(nodes(spark, sf_dir), edges(spark, sf_dir)).groupBy("bid_id", "evidence", "node_type")
    return found.agg(F.count("*").alias("n"), F.min("depth").alias("nearest"), F.max("depth").alias("farthest"), F.array_join(F.sort_array(F.collect_list("decision")), ",").alias("decisions"))


_ENDS_OF = "(SELECT bid_id, {0} AS id, string_agg(kind || '>' || {1}, ',' ORDER BY kind || '>' || {1}) AS {2} FROM edges GROUP BY ALL)"


@register("i07_fact_and_finding_trace", oracle.sql(f"SELECT bid_id, id, node_type, rests_on, used_by FROM nodes LEFT JOIN {_ENDS_OF.format('src', 'dst', 'rests_on')} USING (bid_id, id) LEFT JOIN {_ENDS_OF.format('dst', 'src', 'used_by')} USING (bid_id, id) WHERE node_type IN ('BIDDER_FACT', 'INTEGRITY_FINDING')", "nodes", "edges"))
def _fact_trace(spark, sf_dir):
    return graph.traces(nodes(spark, sf_dir), edges(spark, sf_dir))


@register("i08_registry_evidence", oracle.sql("SELECT bid_id, src AS fact, dst AS evidence FROM edges WHERE kind = 'FACT_GROUNDED_BY' AND contains(src, '.')", "edges"))
def _registry_evidence(spark, sf_dir):
    found = graph._union(audit.grounded(bridge.facts(spark, sf_dir), base.checks(spark, sf_dir)))  # these edges alone, the others are not made
    return found.filter(F.contains("src", F.lit("."))).distinct().select("bid_id", F.col("src").alias("fact"), F.col("dst").alias("evidence"))


_PER_BID = "SELECT what, type, n, round(n::DOUBLE / (SELECT count(*) FROM bids), 6) AS per_bid FROM ({0})"


@register(
    "d23_graph_stats",
    oracle.sql(
        _PER_BID.format("SELECT 'NODE' AS what, node_type AS type, count(*) AS n FROM nodes GROUP BY node_type UNION ALL SELECT 'EDGE', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'FAULT', 'PHANTOM_EDGE', count(DISTINCT id) FROM spoilt_faults WHERE fault LIKE 'DANGLING%' UNION ALL SELECT 'FAULT', 'ORPHAN_NODE', count(*) FROM spoilt_faults WHERE fault = 'ORPHAN_NODE' UNION ALL SELECT 'FAULT', 'CYCLE', count(DISTINCT bid_id) FROM spoilt_edges WHERE src = dst".replace("count(DISTINCT id)", "count(DISTINCT (bid_id, id))")),
        "nodes", "edges", "spoilt_faults", "spoilt_edges", "bids",
    ),
)
def _graph(spark, sf_dir):
    """Nodes and edges by type of the graph, and what an audit finds in the spoilt one: edges to no node, nodes without edges, bids with a cycle."""
    n_bids = bridge.bids(spark, sf_dir).agg(F.count("*").alias("bids"))  # one row
    counted = lambda df, what, kind: df.groupBy(F.lit(what).alias("what"), kind.alias("type")).agg(F.count("*").alias("n"))
    spoilt = _spoilt(spark, sf_dir)
    wrong = graph.faults(*spoilt).select("bid_id", "id", F.when(F.col("fault").isin("DANGLING_SOURCE", "DANGLING_TARGET"), "PHANTOM_EDGE").when(F.col("fault") == "ORPHAN_NODE", F.col("fault")).alias("type")).filter("type is not null").distinct()
    parts = [counted(nodes(spark, sf_dir), "NODE", F.col("node_type")), counted(edges(spark, sf_dir), "EDGE", F.col("kind")), counted(wrong, "FAULT", F.col("type")), counted(audit.cyclic_bids(spoilt[1]), "FAULT", F.lit("CYCLE"))]
    return graph._union(parts).join(F.broadcast(n_bids)).select("what", "type", "n", F.round(F.col("n") / F.col("bids"), 6).alias("per_bid"))


# --- snapshots, overrides, streams ---------------------------------------------------------

_CONFIG = {"aggregator_version": "1", "contradiction_engine_version": "1", "default_evaluation_date": bridge.REFERENCE_DATE, "ontology_version": "1", "precedence_policy": "GTC<STC<ATC", "replay_engine_version": "1", "rule_engine_version": "1"}
_CONFIG_HASH = "sha256('" + json.dumps(_CONFIG, separators=(",", ":"), sort_keys=True) + "')"
_SNAPSHOT = f"""SELECT bid_id, sha256(string_agg(requirement_id || ':' || status || ':' || severity, ';' ORDER BY requirement_id)) AS snapshot_hash, {_CONFIG_HASH} AS config_hash FROM results GROUP BY bid_id"""


@register("j01_snapshots", oracle.sql(_SNAPSHOT, "results"))
def _snapshots(spark, sf_dir):
    return audit.snapshots(base.results(spark, sf_dir), _CONFIG)


def snapshot_records(spark, sf_dir):
    """Snapshots as records to be checked; some are spoilt in each way that a check can tell."""
    return audit.snapshot_records(bridge.bids(spark, sf_dir), base.results(spark, sf_dir), bridge.facts(spark, sf_dir)).withColumns(
        {
            "snapshot_version": F.when(F.col("bid_id") % 11 == 0, "9.9").otherwise(F.col("snapshot_version")),
            "tender_id": F.when(F.col("bid_id") % 13 == 0, " ").otherwise(F.col("tender_id")),
            "snapshot_hash": F.when(F.col("bid_id") % 17 != 0, F.col("snapshot_hash")),
            "bidder_facts": F.when(F.col("bid_id") % 19 == 0, F.transform("bidder_facts", lambda x: F.struct(x["fact_id"].alias("fact_id"), F.lit("").alias("field"), x["source_document"].alias("source_document")))).otherwise(F.col("bidder_facts")),
        }
    )


@register(
    "j02_snapshot_errors",
    oracle.sql(
        """SELECT bid_id, CASE WHEN bid_id % 17 = 0 THEN 'missing snapshot_hash' ELSE concat_ws('; ', CASE WHEN bid_id % 11 = 0 THEN 'unsupported version 9.9' END, CASE WHEN bid_id % 13 = 0 THEN 'empty tender_id' END, CASE WHEN bid_id % 19 = 0 THEN CAST(n_facts AS VARCHAR) || ' facts without field' END) END AS errors
FROM bids JOIN (SELECT bid_id, count(*) AS n_facts FROM facts GROUP BY bid_id) USING (bid_id)""",
        "bids", "facts",
    ),
)
def _snapshot_errors(spark, sf_dir):
    return audit.snapshot_errors(snapshot_records(spark, sf_dir)).select("bid_id", F.array_join("errors", "; ").alias("errors"))


EARLIER = "1994-06-17"


def _inputs(spark, sf_dir):
    """What the snapshot holds: the written tables of all bids, as they were captured."""
    return replay.Inputs(bridge.bids(spark, sf_dir), bridge.requirements(spark), _documents_of(spark, sf_dir), bridge.facts(spark, sf_dir), base.checks(spark, sf_dir), base.debarment(spark, sf_dir), _decided(spark, sf_dir))


def _snapshot_items(spark, sf_dir):
    """The snapshot's layers as the verification gave them."""
    return replay.items(_inputs(spark, sf_dir), replay.Outcome(base.results(spark, sf_dir), base.findings(spark, sf_dir), base.queue(spark, sf_dir), rollup.overall(base.tally(spark, sf_dir)), nodes(spark, sf_dir), edges(spark, sf_dir)))


def _replayed_items(run: str, date: str):
    """The layers of one replay from the snapshot's inputs at an evaluation date."""

    def build(spark, sf_dir):
        inputs = _inputs(spark, sf_dir)
        return replay.items(inputs, replay.run(inputs, date, lambda name, df: tables.once(spark, sf_dir, f"{run}-{name}", lambda: df)))

    return build


def _stored(name: str, build):
    """(items, digests): digests are written once; items, which are hundreds a bid, are made where they are asked for."""
    return build, lambda s, d: tables.once(s, d, f"{name}-digests", lambda: replay.digests(build(s, d)))


SNAPSHOT = _stored("snapshot", _snapshot_items)
SAME, SAME_AGAIN, EARLIER_DATE = (_stored(run, _replayed_items(run, date)) for run, date in (("replay-1", bridge.REFERENCE_DATE), ("replay-2", bridge.REFERENCE_DATE), ("replay-earlier", EARLIER)))


oracle.view("again", "SELECT DISTINCT a, e, op, op_status FROM (" + oracle.readings("(SELECT DISTINCT a, e, op FROM joined)").replace(f"DATE '{bridge.REFERENCE_DATE}'", "DATE '1994-06-17'") + ")", "joined")
oracle.view("results_again", oracle._VIEWS["results"][0].replace("JOIN decided d", "JOIN again d"), "joined", "again")
oracle.clone("_again", "results", "compliance", "queue", "overall", "edges", "nodes")
_JOINED = lambda *c: "concat_ws('|', " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '')" for x in c) + ")"
_ITEMS = f"""SELECT 'REQUIREMENT' AS layer, bid_id, requirement_id AS item, {_JOINED('operator', 'expected_value', 'mandatory')} AS value FROM bids JOIN reqs USING (tender_id)
UNION ALL SELECT 'FACT', bid_id, field || '-' || CAST(fact_seq AS VARCHAR), {_JOINED('value', 'source_document', 'page')} FROM facts
UNION ALL SELECT DISTINCT 'CANONICAL', bid_id, field, coalesce(canonical, '') FROM facts JOIN canon USING (field)
UNION ALL SELECT 'RESULT', bid_id, requirement_id, {_JOINED('status', 'severity', 'requires_review', 'actual')} FROM results
UNION ALL SELECT 'FINDING', bid_id, finding_id, {_JOINED('status', 'finding_type', 'severity')} FROM findings
UNION ALL SELECT 'REVIEW', bid_id, CAST(source_order AS VARCHAR) || ':' || related, {_JOINED('category', 'severity')} FROM queue
UNION ALL SELECT 'AGGREGATION', bid_id, unnest(['compliance_status', 'integrity_status', 'overall_status', 'critical', 'major', 'anomalies']), unnest([compliance_status, integrity_status, overall_status, CAST(critical AS VARCHAR), CAST(major AS VARCHAR), CAST(anomalies AS VARCHAR)]) FROM overall JOIN (SELECT bid_id, critical, major FROM compliance) USING (bid_id)
UNION ALL SELECT 'NODE', bid_id, id, node_type FROM nodes UNION ALL SELECT 'EDGE', bid_id, src || '>' || kind || '>' || dst, '' FROM edges"""
oracle.view("items", _ITEMS, "bids", "reqs", "facts", "canon", "results", "findings", "queue", "overall", "compliance", "nodes", "edges")
oracle.clone("_again", "results", "compliance", "queue", "overall", "edges", "nodes", "items")
_CATEGORY = "CASE layer " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in replay.CATEGORIES.items()) + " END"
_DIFFERENCES = f"SELECT layer, {_CATEGORY} AS category, bid_id, item, a.value AS stored, b.value AS replayed FROM {{0}} a FULL OUTER JOIN {{1}} b USING (layer, bid_id, item) WHERE a.value IS DISTINCT FROM b.value"
#: A snapshot that somebody has changed in each layer, in some bids.
_TAMPERED = """SELECT layer, bid_id, item, CASE WHEN layer = 'REQUIREMENT' AND bid_id % 97 = 0 AND item LIKE '%R01' THEN 'changed' WHEN layer = 'FACT' AND bid_id % 101 = 0 AND item LIKE 'gstin-%' THEN concat(value, '!') WHEN layer = 'CANONICAL' AND bid_id % 103 = 0 AND item = 'pan' THEN 'GSTIN' WHEN layer = 'RESULT' AND bid_id % 107 = 0 AND item LIKE '%R01' THEN 'PASS|INFO|false|' WHEN layer = 'REVIEW' AND bid_id % 109 = 0 AND item LIKE '1:%' THEN 'AMBIGUOUS_COMPLIANCE|INFO' WHEN layer = 'AGGREGATION' AND bid_id % 113 = 0 AND item = 'anomalies' THEN '0!' WHEN layer = 'NODE' AND bid_id % 127 = 0 AND item LIKE 'FIELD:%' THEN 'BIDDER_FACT' ELSE value END AS value
FROM {0} WHERE NOT (layer = 'FINDING' AND bid_id % 89 = 0) AND NOT (layer = 'EDGE' AND bid_id % 131 = 0 AND item LIKE 'REQ:%')
UNION ALL SELECT 'REVIEW', bid_id, '9:PLANTED' AS item, 'MINOR|MINOR' AS value FROM {0} WHERE layer = 'AGGREGATION' AND item = 'anomalies' AND bid_id % 137 = 0"""
oracle.view("tampered", _TAMPERED.format("items"), "items")


def _tampered(spark, sf_dir):
    return spark.sql(_TAMPERED.format("{items}"), items=SNAPSHOT[0](spark, sf_dir))


TAMPERED = _stored("tampered", _tampered)


def _compared(spark, sf_dir, stored, replayed):
    return replay.differences(*(part(spark, sf_dir) for part in (*stored, *replayed)))


@register("j03_replay_differences", oracle.sql(_DIFFERENCES.format("items", "items_again"), "items", "items_again"))
def _replay(spark, sf_dir):
    """The snapshot against a replay at an earlier evaluation date: what depends on the date differs, in every layer that it reaches."""
    return _compared(spark, sf_dir, SNAPSHOT, EARLIER_DATE)


@register("j03_tampered_snapshot", oracle.sql(_DIFFERENCES.format("tampered", "items"), "tampered", "items"))
def _replay_tampered(spark, sf_dir):
    """A snapshot changed in each layer against a replay at the same date."""
    return _compared(spark, sf_dir, TAMPERED, SAME)


_PLACES = "CASE layer " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(replay.CATEGORIES)) + " END"
_VERDICTS = f"SELECT b.bid_id, coalesce(category, '{replay.COMPLETE}') AS status, coalesce(mismatched, 0) AS mismatched FROM bids b LEFT JOIN (SELECT bid_id, count(*) AS mismatched, min_by(category, place) AS category FROM (SELECT DISTINCT bid_id, layer, category, {_PLACES} AS place FROM ({_DIFFERENCES})) GROUP BY bid_id) d ON b.bid_id = d.bid_id"


@register("j03_verdicts", oracle.sql("SELECT 'EARLIER_DATE' AS replay, * FROM (" + _VERDICTS.format("items", "items_again") + ") UNION ALL SELECT 'TAMPERED', * FROM (" + _VERDICTS.format("tampered", "items") + ")", "bids", "items", "items_again", "tampered"))
def _replay_verdicts(spark, sf_dir):
    of = lambda name, stored, replayed: replay.verdicts(bridge.bids(spark, sf_dir), stored[1](spark, sf_dir), replayed[1](spark, sf_dir)).select(F.lit(name).alias("replay"), "*")
    return of("EARLIER_DATE", SNAPSHOT, EARLIER_DATE).unionByName(of("TAMPERED", TAMPERED, SAME))


# Officers' requests: each event asks for something of the bid that has its number; some name nothing, or lack what a request needs.
_TEXT = lambda x: f"CAST({x} AS {{text}})"
_CLAUSE = f"'T' || {_TEXT('event_id % 3 + 1')} || '-R0' || {_TEXT('event_id % 9 + 1')}"
_REQUESTS = f"""SELECT 'ADJ-' || {_TEXT('event_id')} AS adjudication_id, CAST(event_id AS BIGINT) AS bid_id,
CASE event_id % 5 WHEN 0 THEN 'REV-' || {_TEXT('event_id')} || '-' || lpad({_TEXT('event_id % 12 + 1')}, 3, '0') WHEN 1 THEN {_CLAUSE} WHEN 2 THEN 'VERIF-' || {_TEXT('event_id')} || '-' || {_CLAUSE} WHEN 3 THEN 'GSTIN-gstin-000001-gstin-000002' ELSE ' REV-' || {_TEXT('event_id - event_id % 3')} || '-002' END AS target_id,
CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'signup' THEN 'WAIVE' WHEN 'error' THEN 'CONFIRM_FAIL' WHEN 'click' THEN 'DISMISS' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'DISMISS' ELSE 'LOOK' END END AS decision,
CASE WHEN event_id % 41 = 0 THEN ' ' ELSE 'OFF-' || {_TEXT('user_id')} END AS officer_id, CASE WHEN event_id % 47 <> 0 THEN 'Officer ' || {_TEXT('user_id')} END AS officer_name, CASE WHEN event_id % 43 = 0 THEN 'short' ELSE 'Looked at the evidence' END AS justification, ts FROM {{events}}"""
_REQUESTS = f"SELECT adjudication_id, CASE WHEN trim(target_id) LIKE 'REV-%' AND bid_id % 5 = 4 THEN bid_id - bid_id % 3 ELSE bid_id END AS bid_id, target_id, decision, officer_id, officer_name, justification, ts FROM ({_REQUESTS})"
oracle.view("requests", _REQUESTS.format(text="VARCHAR", events="events"))
oracle.view("items_of_queue", f"SELECT *, {base._RUNNING.format('REV', 'source_order, related')} AS review_id FROM queue", "queue")
_FAULT = f"CASE WHEN trim(coalesce(officer_id, '')) = '' THEN 'OFFICER_ID' WHEN trim(coalesce(officer_name, '')) = '' THEN 'OFFICER_NAME' WHEN length(trim(coalesce(justification, ''))) < {adjudication.LEAST_JUSTIFICATION} THEN 'JUSTIFICATION' WHEN upper(coalesce(decision, '')) NOT IN {oracle._list(adjudication.DECISIONS)} THEN 'DECISION' END"
_NAMED = "(SELECT bid_id, unnest([requirement_id, 'VERIF-' || CAST(bid_id AS VARCHAR) || '-' || requirement_id]) AS name, requirement_id FROM results)"
oracle.view(
    "resolved",
    f"""SELECT q.*, q.target_type AS kind, coalesce(fault, CASE WHEN target_type IS NULL THEN 'TARGET' END) AS wrong FROM (SELECT r.adjudication_id, r.bid_id, trim(r.target_id) AS target_id, upper(decision) AS decision, officer_id, justification, ts, {_FAULT} AS fault, i.review_id, coalesce(a.requirement_id, b.requirement_id) AS requirement_id, coalesce(c.finding_id, d.finding_id) AS finding_id, CASE WHEN i.review_id IS NOT NULL THEN 'REVIEW_ITEM' WHEN b.requirement_id IS NOT NULL THEN 'REQUIREMENT' WHEN d.finding_id IS NOT NULL THEN 'INTEGRITY_FINDING' END AS target_type
FROM requests r LEFT JOIN items_of_queue i ON i.bid_id = r.bid_id AND i.review_id = trim(r.target_id) LEFT JOIN {_NAMED} a ON a.bid_id = r.bid_id AND a.name = i.related LEFT JOIN {_NAMED} b ON b.bid_id = r.bid_id AND b.name = trim(r.target_id) LEFT JOIN findings c ON c.bid_id = r.bid_id AND c.finding_id = i.related LEFT JOIN findings d ON d.bid_id = r.bid_id AND d.finding_id = trim(r.target_id)) q""",
    "requests", "items_of_queue", "results", "findings",
)
oracle.view("accepted", "SELECT * FROM resolved WHERE wrong IS NULL", "resolved")


def _queue_items(spark, sf_dir):
    return rollup.numbered(base.queue(spark, sf_dir), "REV", ["source_order", "related"]).withColumnRenamed("running_id", "review_id")


def _named_findings(spark, sf_dir):
    return base.findings(spark, sf_dir).withColumn("finding_id", rollup.finding_id())


def _resolve(spark, sf_dir):
    requests = spark.sql(_REQUESTS.format(text="STRING", events="{events}"), events=bridge.table(spark, sf_dir, "events"))
    return adjudication.resolved(requests, _queue_items(spark, sf_dir), base.results(spark, sf_dir), _named_findings(spark, sf_dir))


resolved = base._once("adjudications", _resolve)


@register("c17_override_targets", oracle.sql("SELECT adjudication_id, bid_id, target_id, wrong AS fault, CASE WHEN wrong IS NULL THEN target_type END AS target_type, CASE WHEN wrong IS NULL THEN requirement_id END AS requirement_id, CASE WHEN wrong IS NULL THEN finding_id END AS finding_id FROM resolved", "resolved"))
def _targets(spark, sf_dir):
    """What each request is about, or why it is rejected."""
    found, shown = resolved(spark, sf_dir), ["adjudication_id", "bid_id", "target_id", "fault", "target_type", "requirement_id", "finding_id"]
    return adjudication.accepted(found).select(shown).unionByName(adjudication.rejects(found), allowMissingColumns=True)


_SAID = "CASE decision WHEN 'ACCEPT' THEN 'OVERRIDDEN_PASS' WHEN 'WAIVE' THEN 'OVERRIDDEN_PASS' WHEN 'CONFIRM_FAIL' THEN 'OVERRIDDEN_FAIL' END"
oracle.view("results_ruled", f"SELECT r.* REPLACE (coalesce({_SAID}, r.status) AS status, r.requires_review AND decision IS NULL AS requires_review) FROM results r LEFT JOIN (SELECT bid_id, requirement_id, max_by(decision, struct_pack(t := ts, a := adjudication_id)) AS decision FROM accepted WHERE decision <> 'DISMISS' AND requirement_id IS NOT NULL GROUP BY ALL) o ON o.bid_id = r.bid_id AND o.requirement_id = r.requirement_id", "results", "accepted")
oracle.view("findings_ruled", "SELECT f.* FROM findings f WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.bid_id = f.bid_id AND a.finding_id = f.finding_id AND decision = 'DISMISS')", "findings", "accepted")
oracle.clone("_ruled", "results", "findings", "compliance", "integ", "weighted", "scores", "factors", "risk", "pend", "recommend")
oracle.view("items_ruled", "SELECT i.bid_id, count(*) FILTER (decision IS NULL) AS open_items FROM items_of_queue i LEFT JOIN (SELECT bid_id, review_id, any_value(decision) AS decision FROM accepted WHERE review_id IS NOT NULL GROUP BY ALL) a ON a.bid_id = i.bid_id AND a.review_id = i.review_id GROUP BY i.bid_id", "items_of_queue", "accepted")


def _ruled(spark, sf_dir):
    return adjudication.results_after(base.results(spark, sf_dir), adjudication.accepted(resolved(spark, sf_dir)))


@register("j04_apply_overrides", oracle.sql("SELECT bid_id, requirement_id, status, requires_review FROM results_ruled", "results_ruled"))
def _apply(spark, sf_dir):
    return _ruled(spark, sf_dir).select("bid_id", "requirement_id", "status", "requires_review")


_LAST = "last_value({0} IGNORE NULLS) OVER (PARTITION BY bid_id, {1} ORDER BY ts, adjudication_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RECORDS = f"""SELECT adjudication_id, bid_id, target_type, target_id, decision, CASE target_type WHEN 'REVIEW_ITEM' THEN item_before WHEN 'REQUIREMENT' THEN result_before ELSE finding_before END AS previous_status,
coalesce(CASE WHEN finding_id IS NOT NULL THEN CASE WHEN decision = 'DISMISS' THEN 'DISMISSED' ELSE finding_before END END, CASE WHEN requirement_id IS NOT NULL THEN coalesce({_SAID}, result_before) END, 'UNKNOWN') AS new_status, sha256(concat_ws(':', adjudication_id, target_id, decision, officer_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), justification)) AS audit_hash FROM (
SELECT a.*, CASE WHEN a.requirement_id IS NOT NULL THEN coalesce({_LAST.format(_SAID, 'a.requirement_id').replace('bid_id', 'a.bid_id')}, r.status) END AS result_before, CASE WHEN a.finding_id IS NOT NULL THEN coalesce({_LAST.format("CASE WHEN decision = 'DISMISS' THEN 'DISMISSED' END", 'a.finding_id').replace('bid_id', 'a.bid_id')}, f.status) END AS finding_before, CASE WHEN a.review_id IS NOT NULL THEN coalesce({_LAST.format("CASE WHEN decision = 'DISMISS' THEN 'DISMISSED' ELSE 'RESOLVED' END", 'a.review_id').replace('bid_id', 'a.bid_id')}, 'OPEN') END AS item_before
FROM accepted a LEFT JOIN results r ON r.bid_id = a.bid_id AND r.requirement_id = a.requirement_id LEFT JOIN findings f ON f.bid_id = a.bid_id AND f.finding_id = a.finding_id)"""


@register("j04_audit_records", oracle.sql(_RECORDS, "accepted", "results", "findings"))
def _audit_records(spark, sf_dir):
    return adjudication.records(adjudication.accepted(resolved(spark, sf_dir)), base.results(spark, sf_dir), _named_findings(spark, sf_dir))


_RULED_BIDS = "SELECT DISTINCT bid_id FROM accepted"


@register("j04_recomputed", oracle.sql(f"SELECT s.bid_id, c.compliance_status, CASE WHEN coalesce(contradictions, 0) > 0 THEN 'CONTRADICTION' ELSE 'CONSISTENT' END AS integrity_status, CASE WHEN s.debarred OR critical > 0 OR major > 0 THEN 'FAIL' WHEN coalesce(open_items, 0) > 0 OR c.missing > 0 OR coalesce(contradictions, 0) > 0 THEN 'REVIEW' ELSE 'PASS' END AS overall_status, coalesce(open_items, 0) AS open_items, round(s.final_score, 6) AS final_score, k.level, v.verdict, v.confidence FROM scores_ruled s JOIN compliance_ruled c ON s.bid_id = c.bid_id JOIN risk_ruled k ON s.bid_id = k.bid_id JOIN recommend_ruled v ON s.bid_id = v.bid_id LEFT JOIN integ_ruled i ON s.bid_id = i.bid_id LEFT JOIN items_ruled q ON s.bid_id = q.bid_id WHERE s.bid_id IN ({_RULED_BIDS})", "scores_ruled", "compliance_ruled", "risk_ruled", "recommend_ruled", "integ_ruled", "items_ruled", "accepted"))
def _recomputed(spark, sf_dir):
    """The bids that decisions are about, worked out again under them."""
    ruled = adjudication.accepted(resolved(spark, sf_dir))
    ours = lambda df: df.join(ruled.select("bid_id").distinct(), "bid_id", "left_semi")
    _, _, known, listed, weak = base.signals(spark, sf_dir)
    t = rollup.tally(ours(bridge.bids(spark, sf_dir)), ours(_ruled(spark, sf_dir)), adjudication.findings_after(ours(_named_findings(spark, sf_dir)), ruled), ours(known), listed, ours(weak))
    return adjudication.recomputed(t, adjudication.items_after(ours(_queue_items(spark, sf_dir)), ruled)).withColumn("final_score", F.round("final_score", 6))


@register("j04_pending", oracle.sql(f"SELECT {base._PENDING} FROM pend_ruled WHERE bid_id IN ({_RULED_BIDS})", "pend_ruled", "accepted"))
def _ruled_pending(spark, sf_dir):
    """What is pending for those bids under the decisions."""
    ours = adjudication.accepted(resolved(spark, sf_dir)).select("bid_id").distinct()
    return rollup.pending(_ruled(spark, sf_dir).join(ours, "bid_id", "left_semi"), base.checks(spark, sf_dir), base.debarment(spark, sf_dir))


_MATCHED = "SELECT '{0}' AS replay, count(*) AS cases, count(*) FILTER (status = 'COMPLETE_MATCH') AS complete_matches, round(100.0::DOUBLE * count(*) FILTER (status = 'COMPLETE_MATCH') / count(*), 2) AS match_rate, {1} AS runs, 100.0::DOUBLE AS determinism_rate FROM ({2})"


@register("j06_replay_rates", oracle.sql(" UNION ALL ".join(_MATCHED.format(*x) for x in (("SAME_DATE", 2, _VERDICTS.format("items", "items")), ("EARLIER_DATE", 1, _VERDICTS.format("items", "items_again")), ("TAMPERED", 2, _VERDICTS.format("tampered", "items")))), "bids", "items", "items_again", "tampered"))
def _replay_rates(spark, sf_dir):
    """How many snapshots replays give again in every layer, and how many bids give one hash over repeated replays."""
    rated = lambda name, stored, runs: replay.rates(bridge.bids(spark, sf_dir), stored[1](spark, sf_dir), [r[1](spark, sf_dir) for r in runs]).select(F.lit(name).alias("replay"), "*")
    return graph._union([rated("SAME_DATE", SNAPSHOT, [SAME, SAME_AGAIN]), rated("EARLIER_DATE", SNAPSHOT, [EARLIER_DATE]), rated("TAMPERED", TAMPERED, [SAME, SAME_AGAIN])])


@register("j05_audit_trail", f"SELECT user_id AS target, count(*) AS n, string_agg({_DECISION}, ',' ORDER BY ts, event_id) AS trail FROM events WHERE {_DECISION} IS NOT NULL GROUP BY user_id")
def _trail(spark, sf_dir):
    return audit.trail(audit.decisions(bridge.table(spark, sf_dir, "events")))


@register("s01_override_stream", f"SELECT user_id AS target, decision FROM (SELECT user_id, {_DECISION} AS decision, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE {_DECISION} IS NOT NULL) WHERE r = 1")
def _override_stream(spark, sf_dir):
    from attestra.streaming import overrides

    return overrides.effective(spark, sf_dir)


@register("s02_audit_stream", "SELECT day, event_type, n, masks, first_print, day + INTERVAL 1 DAY <= latest - INTERVAL 1 DAY AS closed FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT '***' || right('user-' || CAST(user_id AS VARCHAR), 3)) AS masks, min(substring(sha256(coalesce(CAST(props AS VARCHAR), '')), 1, 12)) AS first_print FROM events GROUP BY ALL), (SELECT max(ts) AS latest FROM events)")
def _audit_stream(spark, sf_dir):
    from attestra.streaming import audit_log

    return audit_log.daily_counts(spark, sf_dir)


@register("a06_store_by_id", oracle.sql("SELECT bid_id, n_facts, n_findings, requirement_id, status FROM (SELECT bid_id, requirement_id, status FROM results_ruled WHERE bid_id IN (SELECT bid_id FROM bids ORDER BY bid_id LIMIT 20)) LEFT JOIN (SELECT bid_id, count(*) AS n_facts FROM facts GROUP BY bid_id) USING (bid_id) LEFT JOIN (SELECT bid_id, count(*) AS n_findings FROM findings GROUP BY bid_id) USING (bid_id)".replace("n_findings, requirement_id", "coalesce(n_findings, 0) AS n_findings, requirement_id", 1), "results_ruled", "bids", "facts", "findings"))
def _store(spark, sf_dir):
    """All dossiers are stored; those that officers have decided about are stored again as they are now; twenty are read back by id."""
    from attestra.sources import dossiers as store

    path = files.scratch(spark, "dossier-store")
    store.upsert(dossiers(spark, sf_dir), path, "bid_id")
    ruled = adjudication.accepted(resolved(spark, sf_dir)).select("bid_id").distinct()
    store.upsert(dossiers(spark, sf_dir, _ruled(spark, sf_dir), ruled), path, "bid_id")
    wanted = [r["bid_id"] for r in bridge.bids(spark, sf_dir).orderBy("bid_id").limit(20).collect()]  # twenty ids, as a user would ask for
    found = store.by_ids(spark, path, "bid_id", wanted)
    return found.select("bid_id", F.size("facts").cast("long").alias("n_facts"), F.size("findings").cast("long").alias("n_findings"), F.explode("results").alias("r")).select("bid_id", "n_facts", "n_findings", "r.requirement_id", "r.status")
