"""Queries of sources and sinks, text jobs and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import identifiers, similarity
from attestra.operators import evidence, extraction, registry, text
from attestra.sources import bridge, files

from . import compliance_queries as base
from . import oracle
from .registered import Registered


OWN = Registered()
register = OWN.register


@register("a01_json_scan", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def _json(spark, sf_dir):
    return files.round_trip(bridge.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "json")


_CATEGORIES = {"ECONOMY": "FINANCIAL_CAPACITY", "STANDARD": "TECHNICAL_SPECIFICATION", "PROMO": "DELIVERY", "LARGE": "WARRANTY"}
_CATEGORY_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in _CATEGORIES.items())


@register("a02_flatten_clauses", f"SELECT p_brand AS tender_id, p_partkey AS clause_id, p_name AS description, coalesce(c, 'OTHER') AS category FROM part LEFT JOIN (VALUES {_CATEGORY_ROWS}) t(k, c) ON k = split_part(upper(p_type), ' ', 1)")
def _flatten(spark, sf_dir):
    clause = F.struct(F.col("p_partkey").alias("clause_id"), F.split("p_type", " ")[0].alias("clause_type"), F.col("p_name").alias("description"))
    nested = bridge.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("tender_id"), F.expr("p_partkey div 1000").alias("part")).agg(F.collect_list(clause).alias("clauses"))  # tenders as they come: clauses nested, a thousand a record
    kinds = F.broadcast(spark.createDataFrame(list(_CATEGORIES.items()), "k string, category string"))  # a fixed list
    flat = nested.select("tender_id", F.explode("clauses").alias("c")).select("tender_id", "c.*")
    return flat.join(kinds, F.upper("clause_type") == F.col("k"), "left").select("tender_id", "clause_id", "description", F.coalesce("category", F.lit("OTHER")).alias("category"))


@register("a03_split_pairs", oracle.sql("SELECT 'FACT' AS kind, bid_id, requirement_id AS id, coalesce(a, '') AS content FROM joined WHERE a IS NOT NULL UNION ALL SELECT 'REQUIREMENT', bid_id, requirement_id, operator || ' ' || coalesce(expected_value, '') FROM joined WHERE a IS NOT NULL UNION ALL SELECT 'EXPECTED', j.bid_id, requirement_id, truth FROM joined j JOIN bids b ON j.bid_id = b.bid_id WHERE a IS NOT NULL", "joined", "bids"))
def _split(spark, sf_dir):
    pairs = base.matched(spark, sf_dir).filter("actual is not null").join(bridge.bids(spark, sf_dir).select("bid_id", "truth"), "bid_id")
    row = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    three = F.array(row("FACT", F.col("actual")), row("REQUIREMENT", F.concat_ws(" ", "operator", F.coalesce("expected_value", F.lit("")))), row("EXPECTED", F.col("truth")))
    return pairs.select("bid_id", F.col("requirement_id").alias("id"), F.explode(three).alias("x")).select("x.kind", "bid_id", "id", "x.content")


@register("a04_csv_manifest", "SELECT doc_id, lang, source, n_chars FROM documents")
def _csv(spark, sf_dir):
    return files.round_trip(bridge.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "csv", header="true")


_MANIFEST = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}


@register("a05_manifest", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(DISTINCT {k}) AS n_keys, sha256('{t}:' || CAST(count(*) AS VARCHAR) || ':' || CAST(count(DISTINCT {k}) AS VARCHAR)) AS digest FROM {t}" for t, k in _MANIFEST.items()))
def _manifest(spark, sf_dir):
    """Rows and distinct keys of all tables, counted together in one job."""
    keys = [bridge.table(spark, sf_dir, t).select(F.lit(t).alias("name"), F.col(k).cast("string").alias("key")) for t, k in _MANIFEST.items()]
    whole = keys[0]
    for more in keys[1:]:
        whole = whole.unionByName(more)
    each = whole.groupBy("name", "key").agg(F.count("*").alias("rows"))
    counted = each.groupBy("name").agg(F.sum("rows").alias("n"), F.count("key").alias("n_keys"))
    return counted.withColumn("digest", F.sha2(F.concat_ws(":", "name", "n", "n_keys"), 256))


@register("a05_file_manifest")
def _file_manifest(spark, sf_dir):
    """Name, bytes and SHA-256 of every input file, and the hash of all of them; no SQL reads files as bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(sf_dir)
    return files.manifest(found)


@register("a07_metric_documents", "SELECT event_type, '{\"event_type\":\"' || event_type || '\",\"n\":' || CAST(count(*) AS VARCHAR) || '}' AS document FROM events GROUP BY event_type")
def _metrics(spark, sf_dir):
    n = bridge.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", identifiers.canonical_json(event_type=F.col("event_type"), n=F.col("n")).alias("document"))


@register("a08_blocks", oracle.sql("SELECT doc_id, page_number, position, block_id, length(text) AS size FROM blocks", "blocks"))
def _blocks(spark, sf_dir):
    return bridge.blocks(spark, sf_dir).select("doc_id", "page_number", "position", "block_id", F.length("text").cast("long").alias("size"))


_FAULTS = "CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END + CASE WHEN user_id < 5 THEN 1 ELSE 0 END + CASE WHEN event_id % 4 < 2 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END"


def _records(spark, sf_dir):
    records = bridge.table(spark, sf_dir, "events").withColumns({"blocks": F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("event_id") % 4).cast("int")), "extra": F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("colour"), F.lit("red"))).otherwise(F.create_map(F.lit("note"), F.lit("x")))})
    return files.contract_errors(records, ["event_id"], {"event_type": ["view", "click", "purchase"]}, {"user_id": 5}, sizes={"blocks": 2}, keys={"extra": ["note"]})


@register("a09_contract_check", f"SELECT event_id, CAST({_FAULTS} AS INT) AS n_errors FROM events")
def _contract(spark, sf_dir):
    return _records(spark, sf_dir).select("event_id", F.size("errors").alias("n_errors"))


@register("a09_valid_records", f"SELECT event_id, event_type, user_id FROM events WHERE ({_FAULTS}) = 0")
def _valid_records(spark, sf_dir):
    """The records that keep the contract; the others go no further."""
    return files.valid(_records(spark, sf_dir))[0].select("event_id", "event_type", "user_id")


_PATTERNS = ", ".join(f"('{k}', '(?i){p}')" for k, p in text.FACT_PATTERNS.items())
oracle.view("all_blocks", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, block_id, text FROM blocks UNION ALL SELECT 'B' || CAST(doc_id AS VARCHAR), block_id, text FROM statements", "blocks", "statements")


def all_blocks(spark, sf_dir):
    """The blocks of the documents and of the bids' statements."""
    d = bridge.blocks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "block_id", "text")
    return d.unionByName(bridge.statements(spark, sf_dir).select(F.concat(F.lit("B"), F.col("doc_id").cast("string")).alias("doc_id"), "block_id", "text"))


@register("t01_extract_facts", oracle.sql(f"SELECT doc_id, block_id, field, regexp_extract(text, pattern, 1) AS found FROM all_blocks, (VALUES {_PATTERNS}) p(field, pattern) WHERE regexp_extract(text, pattern, 1) <> ''", "all_blocks"))
def _extract(spark, sf_dir):
    return text.extract(all_blocks(spark, sf_dir)).select("doc_id", "block_id", "field", "found")


# Keywords to look for: how each passage begins, words of licences, and patterns, one of which does not compile.
_LITERALS = ("license", "COPYRIGHT", "the")
_SEARCHES = ("licen[sc]e", "all rights|no warranty", "[a-z]+ing[.,]", "[unclosed")
oracle.view(
    "keywords",
    "SELECT 'B' || CAST(item_id AS VARCHAR) AS keyword_id, substring(text, 1, 24) AS pattern, false AS is_regex FROM benchmark UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"('{'R' if is_regex else 'L'}{k}', '{p}', {str(is_regex).lower()})" for is_regex, some in ((False, _LITERALS), (True, _SEARCHES)) for k, p in enumerate(some))
    + ")",
)


def keywords(spark, sf_dir):
    fixed = [(f"{'R' if is_regex else 'L'}{k}", p, is_regex) for is_regex, some in ((False, _LITERALS), (True, _SEARCHES)) for k, p in enumerate(some)]
    passages = bridge.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("keyword_id"), F.substring("text", 1, 24).alias("pattern"), F.lit(False).alias("is_regex"))
    return passages.unionByName(spark.createDataFrame(fixed, "keyword_id string, pattern string, is_regex boolean"))


@register("t03_keyword_evidence", oracle.sql("SELECT doc_id, keyword_id, x.block_id, x.page_number, trim(x.text) AS snippet FROM (SELECT doc_id, keyword_id, min_by(struct_pack(block_id := block_id, page_number := page_number, text := text), position) AS x FROM blocks, keywords WHERE pattern <> '[unclosed' AND CASE WHEN is_regex THEN regexp_matches(text, '(?i)' || CASE WHEN pattern = '[unclosed' THEN 'x' ELSE pattern END) ELSE contains(lower(text), lower(pattern)) END GROUP BY ALL)", "blocks", "keywords"))
def _keyword(spark, sf_dir):
    return evidence.first_blocks(bridge.blocks(spark, sf_dir), keywords(spark, sf_dir))


_CLEAN, _UNPRINTABLE = oracle.CLEAN, oracle.UNPRINTABLE


@register("t04_page_quality", oracle.sql(f"SELECT block_id, round(score, 4) AS score, CASE WHEN score >= 0.80 THEN 'HIGH' WHEN score >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT block_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN ocr IS NOT NULL THEN CASE WHEN n < 20 THEN greatest(0.2::DOUBLE, least(1.0::DOUBLE, ocr)) * 0.5::DOUBLE ELSE greatest(0.2::DOUBLE, least(1.0::DOUBLE, ocr)) END WHEN n >= 80 AND printable >= 0.85 THEN 0.95::DOUBLE WHEN n >= 20 THEN 0.70::DOUBLE ELSE 0.35::DOUBLE END) * printable END AS score FROM (SELECT block_id, ocr, length(c) AS n, 1 - {_UNPRINTABLE}::DOUBLE / nullif(length(c), 0) AS printable FROM (SELECT block_id, CASE WHEN position % 3 = 0 THEN (position % 10) / 10.0::DOUBLE END AS ocr, {_CLEAN} AS c FROM blocks)))", "blocks"))
def _quality(spark, sf_dir):
    score, confidence = text.quality(F.col("text"), ocr=F.when(F.col("position") % 3 == 0, (F.col("position") % 10) / 10.0))
    return bridge.blocks(spark, sf_dir).select("block_id", score.alias("score"), confidence.alias("confidence"))


oracle.view("run_sizes", oracle.RUN_SIZES.format("blocks"), "blocks")
oracle.view("validated", oracle.validated("(SELECT *, greatest(0.1::DOUBLE, least(1.0::DOUBLE, (doc_id % 10) / 10.0::DOUBLE)) AS sure_of FROM blocks)"), "blocks")


def validated(spark, sf_dir):
    composite, status = text.validity(F.col("text"), (F.col("doc_id") % 10) / 10.0)
    return bridge.blocks(spark, sf_dir).withColumns({"composite": composite, "validity": status})


@register("h27_longest_run", oracle.sql("SELECT b.block_id, round(coalesce(c, 0)::DOUBLE / greatest(1, length(text)), 6) AS share FROM blocks b LEFT JOIN run_sizes r ON b.block_id = r.block_id", "blocks", "run_sizes"))
def _run(spark, sf_dir):
    return bridge.blocks(spark, sf_dir).select("block_id", text.longest_run_share(F.col("text")).alias("share"))


@register("t05_validity", oracle.sql("SELECT block_id, composite, validity FROM validated", "validated"))
def _validity(spark, sf_dir):
    return validated(spark, sf_dir).select("block_id", "composite", "validity")


_NUMBER = "CASE WHEN doc_id % 2 = 0 THEN text || ' warranty: 3 years' ELSE text END"


@register("t06_gated_facts", oracle.sql(f"SELECT block_id, field, found, validity = 'LOW_CONFIDENCE' AS for_review FROM (SELECT v.block_id, v.validity, field, regexp_extract({_NUMBER}, pattern, 1) AS found FROM validated v, (VALUES {_PATTERNS}) p(field, pattern)) WHERE found <> '' AND validity <> 'FAILED'", "validated"))
def _gated(spark, sf_dir):
    gated = validated(spark, sf_dir).filter("validity <> 'FAILED'").withColumn("text", F.expr(_NUMBER))
    return text.extract(gated).select("block_id", "field", "found", (F.col("validity") == "LOW_CONFIDENCE").alias("for_review"))


@register("c14_grounding", oracle.sql("SELECT doc_id AS candidate_id, bool_and(k <= n_blocks) AS grounded, count(*) AS n_blocks, coalesce(string_agg(CASE WHEN k <= n_blocks THEN CAST(k - 1 AS VARCHAR) END, ',' ORDER BY k), '') AS resolved FROM (SELECT doc_id, count(*) AS n_blocks FROM blocks GROUP BY doc_id), (VALUES (1), (2), (5)) t(k) GROUP BY doc_id", "blocks"))
def _ground(spark, sf_dir):
    blocks = bridge.blocks(spark, sf_dir).withColumn("block_id", F.col("position").cast("string"))
    wanted = bridge.table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("candidate_id"), "doc_id", F.array(F.lit("0"), F.lit("1"), F.lit("4"), F.lit("1")).alias("block_ids"))
    return text.ground(wanted, blocks).withColumn("resolved", F.array_join(F.transform("resolved", lambda x: x["block_id"]), ","))


# Candidates of the statements: each line states its warranty, over its own block and the next.
_MERGED = """SELECT doc_id, value_key, n, mandatory, description, blocks FROM (SELECT doc_id, value_key, run, count(*) AS n, bool_or(mandatory) AS mandatory, arg_max(description, length(description) * 1000 - page_number) AS description, max(page_number) - min(page_number) + 2 AS blocks FROM (
SELECT *, sum(new) OVER (PARTITION BY doc_id, value_key ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT doc_id, page_number, CAST(l_partkey % 2 + 1 AS VARCHAR) || 'years' AS value_key, l_partkey % 3 = 0 AS mandatory, s_name || repeat('x', CAST(l_partkey % 4 AS INT)) AS description, CASE WHEN page_number - lag(page_number) OVER (PARTITION BY doc_id, l_partkey % 2 ORDER BY page_number) <= 1 THEN 0 ELSE 1 END AS new FROM statements)) GROUP BY doc_id, value_key, run)"""


@register("g08_merge_candidates", oracle.sql(_MERGED, "statements"))
def _merge(spark, sf_dir):
    page, key = F.col("page_number"), F.col("l_partkey")
    c = bridge.statements(spark, sf_dir).select(
        "doc_id", "page_number", F.when(key % 5 == 0, "Warranty Years").otherwise("warranty_years").alias("field"), F.concat((key % 2 + 1).cast("string"), F.when(key % 7 == 0, "_years").otherwise(" years")).alias("value"), (key % 3 == 0).alias("mandatory"),
        F.concat("s_name", F.repeat(F.lit("x"), (key % 4).cast("int"))).alias("description"), F.array(F.concat(F.lit("s"), page.cast("string")), F.concat(F.lit("s"), (page + 1).cast("string"))).alias("blocks"),
    )
    return extraction.merged(c, ["page_number"]).select("doc_id", "value_key", "n", "mandatory", "description", F.size("blocks").alias("blocks"))


_DESCRIPTIONS = ("Exemption* from turnover: BoQ compliance document", "Land border undertaking: registration with the Competent Authority", "Documents required from seller: OEM Annual Turnover, OEM Authorization*", "Documents required from seller: Compliance of BoQ", "Delivery in time", "Seeking exemption from experience")
_DESCRIPTION = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(_DESCRIPTIONS)) + " END"


@register("t07_decompose", f"""WITH c AS (SELECT p_brand AS doc_id, p_partkey AS candidate_id, p_partkey % 6 AS k, p_partkey % 6 IN (0, 2) AS asks FROM part),
m AS (SELECT *, coalesce(bool_or(asks) OVER (PARTITION BY doc_id ORDER BY candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS asked FROM c)
SELECT doc_id, candidate_id, unnest(CASE k WHEN 0 THEN ['boq_compliance_document', 'exemption_supporting_documents'] WHEN 1 THEN ['land_border_registration', 'land_border_compliance_undertaking'] WHEN 2 THEN ['clause', 'oem_annual_turnover_document', 'oem_authorization_certificate'] || CASE WHEN asked THEN [] ELSE ['exemption_supporting_documents'] END WHEN 3 THEN ['clause', 'boq_compliance_document'] ELSE ['clause'] END) AS field FROM m""")
def _decompose(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("candidate_id"), F.expr(_DESCRIPTION).alias("description"), F.lit("clause").alias("field"), F.lit("OTHER").alias("category"), F.lit("EXISTS").alias("operator"), F.lit("").alias("expected_value"))
    return extraction.decomposed(c).select("doc_id", "candidate_id", "field")


# What a model would answer for each statement: its warranty twice (two passes), its turnover in two forms, and an undertaking at the border that is two requirements; some answers
# are broken, name unknown blocks, digits that the block does not have, operators that do not exist or categories that are none, or lack what a requirement needs.
_KEPT = "l_partkey % 10 <> 0 AND l_partkey % 7 <> 0"
oracle.view("extracted", f"""SELECT doc_id, page_number, 'warranty_years' AS field, 'COMMERCIAL_TERMS' AS category, '>=' AS operator, 'WARRANTY_DURATION' AS canonical, CAST(CASE WHEN l_partkey % 6 = 5 THEN 99 ELSE l_partkey % 5 + 1 END * 12 AS VARCHAR) AS normalised, true AS mandatory, 2 AS n, CASE WHEN l_partkey % 6 = 5 AND NOT contains(text, '99') THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END AS grounding FROM statements WHERE {_KEPT}
UNION ALL SELECT doc_id, page_number, 'turnover_cr', 'OTHER', '>=', 'ANNUAL_TURNOVER', CAST((CAST(l_quantity AS INT) % 5 + 1) * 10000000 AS VARCHAR), false, 1, 'ACCEPTED' FROM statements WHERE {_KEPT} AND l_partkey % 8 <> 0
UNION ALL SELECT doc_id, page_number, f, t, o, NULL, NULL, true, 1, 'ACCEPTED' FROM statements, (VALUES ('land_border_registration', 'STATUTORY_ELIGIBILITY', '=='), ('land_border_compliance_undertaking', 'LEGAL_UNDERTAKING', 'EXISTS')) b(f, t, o) WHERE {_KEPT} AND l_partkey % 3 = 0""", "statements")  # fmt: skip
_BORDER = "Land border undertaking and registration with the Competent Authority"


def _claim(field, value, mandatory, *, category="", operator=">=", description="d"):
    return F.format_string('{"description":"%s","category":"%s","field":"%s","operator":"%s","expected_value":"%s","mandatory":%s,"evidence_block_ids":["%s","%s"]}', F.lit(description), F.lit(category), F.lit(field), operator if not isinstance(operator, str) else F.lit(operator), value, F.lit(mandatory), "asked_block", "asked_block")


def extracted(spark, sf_dir):
    st = bridge.statements(spark, sf_dir)
    key = F.col("l_partkey")
    st = st.withColumn("asked_block", F.when(key % 7 == 0, "nowhere").otherwise(F.col("block_id")))
    crore = F.col("l_quantity").cast("int") % 5 + 1
    w = _claim("warranty_years", F.concat(F.when(key % 6 == 5, "99").otherwise((key % 5 + 1).cast("string")), F.lit(" years")), "true", category="COMMERCIAL_TERMS")
    t = _claim("turnover_cr", F.concat(crore.cast("string"), F.lit(" crore")), "false", category="MONEY", operator=F.when(key % 8 == 0, "ABOUT").otherwise(">="))
    lakh = _claim("turnover_cr", F.concat((crore * 10000000).cast("string"), F.lit(".0")), "false", category="DELIVERY_LOGISTICS", operator=F.when(key % 8 == 0, "~").otherwise(">="))  # the same value, later
    border = F.when(key % 3 == 0, F.regexp_replace(_claim("border", F.lit("@"), "true", description=_BORDER), '"expected_value":"@",', ""))
    nobody = _claim("pan", F.lit(""), "null")  # whether it is mandatory is not said
    answer = F.concat(F.lit('```json\n{"requirements":['), F.concat_ws(",", w, w, t, lakh, border, nobody), F.when(key % 10 == 0, "").otherwise("]}"), F.lit("\n```"))
    asked = st.select(F.concat_ws("/", F.col("doc_id").cast("string"), "block_id").alias("doc_id"), answer.alias("payload"))
    blocks = st.select(F.concat_ws("/", F.col("doc_id").cast("string"), "block_id").alias("doc_id"), "block_id", "page_number", "text")
    return extraction.requirements(asked, blocks)


@register("t08_extract_requirements", oracle.sql("SELECT CAST(doc_id AS VARCHAR) || '/s' || CAST(page_number AS VARCHAR) AS doc_id, field, category, operator, canonical, normalised, mandatory, n, grounding FROM extracted", "extracted"))
def _requirements(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", "field", "category", "operator", "canonical", "normalised", "mandatory", "n", "grounding")


_FACT_CLAIMS = {  # by field: the stated value, when it is wrong, and how its support is named
    "gstin": ("CASE WHEN l_partkey % 8 = 0 THEN '99ZZZZZ0000F1Z9' ELSE {gstin} END", "l_partkey % 8 = 0", "EXACT_IDENTIFIER_MATCH", "IDENTIFIER_MISMATCH"),
    "warranty_months": ("CAST((l_partkey % 5 + CASE WHEN l_partkey % 9 = 0 THEN 50 ELSE 1 END) * 12 AS VARCHAR) || ' months'", "l_partkey % 9 = 0", "DURATION_NORMALIZED_MATCH", "DURATION_MISMATCH"),
    "turnover_cr": ("CAST((CAST(l_quantity AS INT) % 5 + 1) * 100 + CASE WHEN l_partkey % 11 = 0 THEN 7 ELSE 0 END AS VARCHAR) || ' lakh'", "l_partkey % 11 = 0", "CURRENCY_MATCH", "NUMERIC_MISMATCH"),
    "local_support": ("'Yes'", "NOT (l_partkey % 4 = 0)", "BOOLEAN_AFFIRMED", "BOOLEAN_UNSUPPORTED"),
    "quality_standard": ("'ISO 9001:2015'", "l_partkey % 3 <> 0", "EXACT_SUBSTRING_MATCH", "CODE_MISMATCH"),
    "seller_note": ("'Warranty Turnover Delivery zzz'", "false", "TOKEN_CONTAINMENT_MATCH", ""),
    "remark": ("''", "true", "", "EMPTY_VALUE"),
    "is_available": ("'No'", "false", "BOOLEAN_NEGATIVE_ACCEPTED", ""),
}
_FACT_CLAIMS["local_support"] = ("'Yes'", "true", "", "CASE WHEN l_partkey % 4 <> 0 THEN 'BOOLEAN_UNSUPPORTED' WHEN l_partkey % 3 <> 0 THEN 'NEGATED_BOOLEAN' ELSE 'BOOLEAN_AFFIRMED' END")


def _outcome_sql(field):
    _, wrong, good, bad = _FACT_CLAIMS[field]
    quoted = lambda x: x if x.startswith("CASE") else f"'{x}'"
    return f"CASE WHEN {wrong} THEN {quoted(bad)} ELSE {quoted(good)} END"


oracle.view("claims", " UNION ALL ".join(f"SELECT doc_id, page_number, {k} AS place, '{f}' AS field, {c[0].format(gstin=oracle.gstin('l_suppkey'))} AS value, {_outcome_sql(f)} AS outcome FROM statements" for k, (f, c) in enumerate(_FACT_CLAIMS.items())), "statements")


def claims(spark, sf_dir):
    """What is claimed of each statement: values of all fields, right and wrong ones."""
    values = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(f).alias("field"), F.expr(c[0].format(gstin="gstin").replace("VARCHAR", "STRING")).alias("value")) for k, (f, c) in enumerate(_FACT_CLAIMS.items())])
    st = bridge.statements(spark, sf_dir).withColumn("gstin", bridge.gstin_of("l_suppkey"))
    return st.select("doc_id", "page_number", "block_id", "text", F.explode(values).alias("x")).select("doc_id", "page_number", "block_id", "text", "x.*")


@register("t02_value_support", oracle.sql("SELECT doc_id, page_number, field, value, outcome AS support FROM claims", "claims"))
def _support(spark, sf_dir):
    return claims(spark, sf_dir).select("doc_id", "page_number", "field", "value", text.support(F.col("value"), F.col("field"), F.col("text")).alias("support"))


_SUPPORTED = oracle._list(text.SUPPORTED)


@register("t09_extract_facts", oracle.sql(f"SELECT format('FACT-{{}}/s{{}}-{{}}-{{:03d}}', CAST(doc_id AS VARCHAR), CAST(page_number AS VARCHAR), upper(field), place + 1) AS fact_id, field, value, page_number AS page, CASE WHEN place % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, outcome FROM claims WHERE outcome IN {_SUPPORTED} AND value <> ''", "claims"))
def _facts(spark, sf_dir):
    """What a model would answer about each statement, as a payload; every second claim names its block twice."""
    key, block = F.concat_ws("/", F.col("doc_id").cast("string"), "block_id"), F.col("block_id")
    one = F.struct("field", F.col("value").alias("raw_value"), F.when(F.col("place") % 2 == 0, F.array(block)).otherwise(F.array(block, block)).alias("evidence_block_ids"))
    said = claims(spark, sf_dir).groupBy(key.alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("place", one.alias("x")))).alias("all"))  # the claims of one statement
    payloads = said.select("doc_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.transform("all", lambda c: c["x"]).alias("facts"))), F.lit("\n```")).alias("payload"))
    blocks = bridge.statements(spark, sf_dir).select(key.alias("doc_id"), "block_id", "page_number", "text")
    return extraction.facts(extraction.parsed_facts(payloads, "payload"), blocks).select("fact_id", "field", "value", "page", "confidence", "outcome")


# Gold items: the warranty (under another name, or with another value, for some) and the turnover of each statement; some lie in a block that no answer names.
_GOLD = """SELECT {id} AS doc_id, block_id, l_partkey, 'WARRANTY' AS category, CASE WHEN l_partkey % 4 = 0 THEN 'guarantee_period' ELSE 'warranty_years' END AS field, 'WARRANTY_DURATION' AS canonical, CAST((l_partkey % 5 + 1) * 12 + CASE WHEN l_partkey % 9 = 0 THEN 12 ELSE 0 END AS {text}) AS normalised FROM {0}
UNION ALL SELECT {id}, block_id, l_partkey, 'FINANCIAL_CAPACITY', 'turnover_cr', 'ANNUAL_TURNOVER', CAST((CAST(l_quantity AS INT) % 5 + 1) * 10000000 AS {text}) FROM {0}"""
oracle.view("gold", _GOLD.format("statements", id="CAST(doc_id AS VARCHAR) || '/' || block_id", text="VARCHAR"), "statements")
oracle.view("gold_matches", """SELECT g.category, g.doc_id, max(CASE WHEN e.field = g.field AND e.normalised = g.normalised THEN 2 WHEN e.canonical = g.canonical OR e.normalised = g.normalised THEN 1 ELSE 0 END) AS rank
FROM gold g LEFT JOIN (SELECT *, CAST(doc_id AS VARCHAR) || '/s' || CAST(page_number AS VARCHAR) AS key FROM extracted) e ON e.key = g.doc_id AND g.l_partkey % 13 <> 0 GROUP BY g.category, g.doc_id""", "gold", "extracted")  # fmt: skip


@register("c19_gold_recall", oracle.sql("SELECT category, count(*) AS gold, count(*) FILTER (rank = 2) AS exact, count(*) FILTER (rank = 1) AS semantic, count(*) FILTER (coalesce(rank, 0) = 0) AS missed, round(count(*) FILTER (rank > 0)::DOUBLE / count(*), 6) AS recall, round(count(*) FILTER (rank = 2)::DOUBLE / count(*), 6) AS exact_recall FROM gold_matches GROUP BY category", "gold_matches"))
def _recall(spark, sf_dir):
    gold = spark.sql(_GOLD.format("{st}", id="CAST(doc_id AS STRING) || '/' || block_id", text="STRING"), st=bridge.statements(spark, sf_dir))
    gold = gold.withColumns({"gold_id": F.concat_ws("/", "doc_id", "category"), "blocks": F.when(F.col("l_partkey") % 13 == 0, F.array(F.lit("elsewhere"))).otherwise(F.array("block_id"))})
    found = extracted(spark, sf_dir).withColumn("found_id", F.concat_ws("/", "doc_id", "requirement_id"))
    return extraction.gold_recall(extraction.gold_matches(gold, found))


@register("h20_page_boxes", "SELECT event_id, list_transform([least(y0, y1), least(x0, x1), greatest(y0, y1), greatest(x0, x1)], lambda v: round(v, 2)) AS box FROM (SELECT event_id, least(595.0::DOUBLE, (user_id * 7 % 700)::DOUBLE) AS x0, least(842.0::DOUBLE, (user_id * 13 % 900)::DOUBLE) AS y0, least(595.0::DOUBLE, (event_id % 650)::DOUBLE) AS x1, least(842.0::DOUBLE, (event_id % 880)::DOUBLE) AS y1 FROM events)")
def _boxes(spark, sf_dir):
    c = F.col
    return bridge.table(spark, sf_dir, "events").select("event_id", text.page_box(c("user_id") * 7 % 700, c("user_id") * 13 % 900, c("event_id") % 650, c("event_id") % 880, 595, 842).alias("box"))


_PATHS = ("x/tenders/a.pdf", "x/bids/b.pdf", "gem_12.pdf", "x/Technical-part.pdf", "boq.xls", "iso9001.pdf", "an-undertaking.pdf", "other.pdf", "TENDER-9.pdf", "bid-7.pdf")
_PATH = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_PATHS)) + " END"
_HEAD = "CASE WHEN doc_id % 4 = 3 THEN 'Technical Bid ' || text ELSE text END"
_NAME = "regexp_extract(p, '[^/]*$', 0)"


@register("h22_document_types", f"SELECT doc_id, CASE WHEN contains(p, '/tenders/') OR starts_with({_NAME}, 'tender-') THEN 'TENDER' WHEN contains(p, '/bids/') OR starts_with({_NAME}, 'bid-') THEN 'BID' WHEN regexp_matches({_NAME}, '^gem_|^nit|tender') THEN 'TENDER' WHEN regexp_matches({_NAME}, 'technical|tech_bid') OR contains(t, 'technical bid') THEN 'TECHNICAL_BID' WHEN regexp_matches({_NAME}, 'financial|boq|price_bid') THEN 'FINANCIAL_BID' WHEN regexp_matches({_NAME}, 'cert|udyam|iso|pan|gst') THEN 'CERTIFICATE' WHEN regexp_matches({_NAME}, 'decl|undertaking|affidavit') THEN 'DECLARATION' ELSE 'UNKNOWN' END AS document_type FROM (SELECT doc_id, lower({_PATH}) AS p, lower(substring({_HEAD}, 1, 300)) AS t FROM documents)")
def _types(spark, sf_dir):
    return bridge.table(spark, sf_dir, "documents").select("doc_id", text.document_type(F.expr(_PATH), F.expr(_HEAD)).alias("document_type"))


@register("h23_ids_of_names", "SELECT page_id, upper(regexp_extract('Bid-' || CAST(page_id AS VARCHAR) || url, '(?i)BID-\\d+', 0)) AS bid FROM pages")
def _ids(spark, sf_dir):
    return bridge.table(spark, sf_dir, "pages").select("page_id", F.upper(F.regexp_extract(F.concat(F.lit("Bid-"), F.col("page_id").cast("string"), "url"), r"(?i)BID-\d+", 0)).alias("bid"))


@register("h25_sanitized_details", "SELECT event_id, '***' || right('key' || CAST(user_id AS VARCHAR) || 'xyz', 4) AS masked, substring(sha256(event_type), 1, 12) AS hashed, '[REDACTED]' AS redacted, event_type AS kept FROM events")
def _sanitized(spark, sf_dir):
    u = F.col("user_id").cast("string")
    details = F.create_map(F.lit("identifier"), F.concat(F.lit("key"), u, F.lit("xyz")), F.lit("client_token"), F.col("event_type"), F.lit("Authorization"), F.concat(F.lit("Bearer "), u), F.lit("note"), F.col("event_type"))
    clean = identifiers.sanitized(details)
    return bridge.table(spark, sf_dir, "events").select("event_id", clean["identifier"].alias("masked"), clean["client_token"].alias("hashed"), clean["Authorization"].alias("redacted"), clean["note"].alias("kept"))


@register("t10_registry_facts", oracle.sql("SELECT bid_id, registry, d.field AS field, d.value AS value FROM (SELECT bid_id, registry, unnest(details) AS d FROM checks WHERE status = 'VERIFIED') WHERE d.value IS NOT NULL", "checks"))
def _registry_facts(spark, sf_dir):
    return registry.facts_of(base.checks(spark, sf_dir))


_CERTIFIED = ", ".join(f"('{k}', '{f}', '{c}')" for k, (f, c) in registry.CERTIFIED.items())


@register("t11_certificate_facts", oracle.sql(f"SELECT bid_id, c.registry, field, canonical, identifier AS value, status, CASE status WHEN 'VERIFIED' THEN 'HIGH' ELSE 'LOW' END AS confidence FROM checks c JOIN (VALUES {_CERTIFIED}) k(registry, field, canonical) ON k.registry = c.registry", "checks"))
def _certificates(spark, sf_dir):
    return registry.certificates(base.checks(spark, sf_dir))


@register("u01_name_similarity")
def _similar(spark, sf_dir):
    c = base.gst_checks(spark, sf_dir).filter("registered_name is not null").select("bid_id", "registered_name", "expected_name")
    return similarity.alike(c, "registered_name", "expected_name").select("bid_id", "alike")


@register("u01_edit_similarity", oracle.sql("SELECT bid_id, round(1 - levenshtein(holder, expected_name)::DOUBLE / greatest(length(holder), length(expected_name), 1), 6) AS ratio FROM checks WHERE registry = 'GST' AND holder IS NOT NULL", "checks"))
def _edit(spark, sf_dir):
    return base.gst_checks(spark, sf_dir).filter("registered_name is not null").select("bid_id", similarity.edit_ratio("registered_name", "expected_name").alias("ratio"))


@register("h21_box_checks", "SELECT event_id, CASE WHEN b[1] < 0 OR b[2] < 0 OR b[3] < 0 OR b[4] < 0 THEN 'NEGATIVE' WHEN b[3] <= b[1] OR b[4] <= b[2] THEN 'ORDER' WHEN b[3] > 842 OR b[4] > 595 THEN 'BOUNDS' ELSE 'OK' END AS outcome FROM (SELECT event_id, [user_id * 13 % 900 - 20, user_id * 7 % 700, event_id % 900, event_id % 650] AS b FROM events)")
def _box_checks(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    box = F.array(*[v.cast("double") for v in (u * 13 % 900 - 20, u * 7 % 700, e % 900, e % 650)])
    return bridge.table(spark, sf_dir, "events").withColumn("b", box).select("event_id", text.valid_box(F.col("b"), 595, 842).alias("outcome"))


_PAYLOAD = "concat('```json\\n[{\"id\": ', event_id, ', \"field\": \"', event_type, '\"}', CASE WHEN event_id % 10 = 0 THEN '' ELSE ']' END, '\\n```')"


@register("h24_candidate_payloads", "SELECT event_id AS id, event_type AS field FROM events WHERE event_id % 10 <> 0")
def _payloads(spark, sf_dir):
    raw = bridge.table(spark, sf_dir, "events").select(F.expr(_PAYLOAD).alias("payload"))
    return text.candidates(raw, "payload", "array<struct<id bigint, field string>>")
