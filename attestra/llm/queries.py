"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprint, html_text, lexical, line_dedup, quality, sharding, simhash, storage, substring_dedup, token_store, toxicity, whitening

VOCABULARY = os.environ.get("ATTESTRA_BPE_VOCABULARY", "")


def vocabulary_path() -> str:
    """The byte-level vocabulary; a parameter of the operators, by default the installed public one."""
    if VOCABULARY:
        return VOCABULARY
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), vocabulary_path(), path, end_id=0)
    return token_store.with_crc(token_store.read_store(spark, path))


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM iw),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND win.g = array_to_string(w[s : s + dw.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host=F.col("source"), path=F.concat_ws("/", "source", "lang"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.counted(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS no FROM l),
c AS (SELECT doc_id, no, length(line) AS n, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM x),
e AS (SELECT a.doc_id, a.no, min(b.no) AS hi FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.no >= a.no AND b.upto >= a.upto - a.n + 200 GROUP BY ALL
UNION SELECT b.doc_id, max(a.no), b.no FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.no >= a.no AND b.upto >= a.upto - a.n + 200 GROUP BY b.doc_id, b.no),
r AS (SELECT e.doc_id, e.no AS lo, hi, row_number() OVER (PARTITION BY array_to_string(w[e.no : hi], chr(10)), hi - e.no ORDER BY e.doc_id, e.no) AS copy FROM e JOIN l ON e.doc_id = l.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS no FROM r WHERE copy > 1),
runs AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT run) AS n_runs, list(no) AS nos FROM (SELECT doc_id, no, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM gone) GROUP BY doc_id),
kept AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.no) AS t FROM x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.no = g.no WHERE g.no IS NULL GROUP BY x.doc_id)
SELECT l.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM l LEFT JOIN runs ON l.doc_id = runs.doc_id LEFT JOIN kept ON l.doc_id = kept.doc_id
"""


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assigned(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_quartile_digest": op2_quartile_digest,
    "op3_html_text": op3_html_text,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_feistel_shards": op11_feistel_shards,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op10_line_dedup": OP10_SQL, "op11_feistel_shards": sharding.oracle_sql(), "op13_ranked_search": lexical.SQL}
