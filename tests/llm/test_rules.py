"""Rules of single operators against plain versions, and that time and memory stay in bounds."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import fingerprint, html_text, quality, simhash, storage, substring_dedup, token_store, toxicity
from attestra.llm.queries import vocabulary_path


def seconds(f):
    began = time.process_time()
    f()
    return time.process_time() - began


# --- 1: token store ------------------------------------------------------------------------


def test_a_point_read_skips_row_groups_and_a_range_read_skips_files(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text number"), "id").alias("text"))
    path = storage.new_path(spark, "store")
    token_store.write_store(docs, vocabulary_path(), path, row_index_stride=1000)

    def rows_read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.executedPlan()
        leaf = plan.collectLeaves().apply(0)
        return leaf.metrics().apply("numOutputRows").value()

    assert rows_read(spark.read.schema(token_store.STORE_SCHEMA).orc(path)) == 4000
    assert rows_read(token_store.lookup(spark, path, [17])) <= 1000
    assert [r["doc_id"] for r in token_store.lookup(spark, path, [17]).collect()] == [17]


def test_rows_that_share_an_id_are_in_order(spark):
    rows = [(1, f"text {k:03d}") for k in range(200)] + [(None, "x"), (0, "a")]
    path = storage.new_path(spark, "store")
    token_store.write_store(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), vocabulary_path(), path)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0] + [1] * 200
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]


# --- 2: digests ----------------------------------------------------------------------------


def test_likeness_of_neighbours(docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (d, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        own, e, f = (fingerprint.digest(x.encode()) for x in (t, edited, n))
        want.append((d, own.hex(), e.hex(), fingerprint.likeness(own, e), fingerprint.likeness(own, f)))
    got = [(r["doc_id"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprint.edited_neighbours(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_document_is_its_own_successor(spark):
    (r,) = fingerprint.edited_neighbours(spark.createDataFrame([(5, "abcdefgh")], "doc_id bigint, text string")).collect()
    assert r["near_next"] == 1.0 and r["n_chars"] == 8


# --- 3: main text --------------------------------------------------------------------------

LONG = "a long sentence of the article that goes on for quite a while, word after word. "
PAGE = f"<body><div>Home <a href=/>Start</a></div><div><a href=/a>News of the day</a> <a href=/b>Sports of the week</a></div><div><h2>The title</h2><p>{LONG * 4}</p><p>Short.</p><p>{LONG * 3}</p></div><div>Copyright 2020 by us. All rights reserved.</div></body>"
TEXT = f"The title {(LONG * 4).strip()} Short. {(LONG * 3).strip()}"


def test_a_page_without_marks_is_cut_by_its_distribution():
    assert html_text.main_text(PAGE) == TEXT
    everything = html_text.main_text(PAGE, surge=0.0, dive=0.0)  # every line surges
    assert "Copyright" in everything and everything != TEXT


def test_passages_equal_their_definition():
    random.seed(4)
    for _ in range(500):
        weights = [random.choice([0, 0, 1, 5, 40, 200]) for _ in range(random.randrange(0, 25))]
        sums = [sum(weights[k : k + 3]) for k in range(len(weights))]
        most, want, k = max(sums, default=0), [], 0
        while k < len(weights) and most:
            if weights[k] and sums[k] >= 0.3 * most:
                end = next((j for j in range(k + 1, len(weights)) if sums[j] < 0.1 * most), len(weights))
                want.append((k, end - 1))
                k = end
            k += 1
        assert html_text.passages(weights) == want


def test_nothing_of_an_article_goes_for_its_class_or_length():
    for name in ("social-science", "search-algorithms", "alert-system", "no-sidebar", "related-work"):
        assert html_text.main_text(f"<article><p>{LONG}</p><section class={name}><p>kept</p></section></article>").endswith("kept")
    page = f"<article><h1>Title</h1><div class='ad'>buy</div><p>{LONG * 9}</p><aside>side</aside><p>end</p></article><article><p>second</p></article>"
    assert html_text.main_text(page) == f"Title {(LONG * 9).strip()} end second"


@pytest.mark.parametrize("bad", ["</x>", "<a ", '<p title="', "<p>", "<div>", "<b><p>", "<", "<!--", "<p a='>", "<script>", "<a href=x>t</a>", "<p>t</div>", "&amp", "<div class='a b'>x", "<article>"])
def test_time_grows_with_a_page_s_length(bad):
    assert seconds(lambda: html_text.main_text(bad * 20_000)) < 2


def test_columns_of_pages_may_have_any_names(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (None, None, None, None, None)], "page_id bigint, url string, html string, text string, n_chars string")
    assert sorted(map(tuple, html_text.extract(rows).collect()), key=str) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)], key=str)


# --- 4: substring dedup --------------------------------------------------------------------


@pytest.mark.parametrize("limit", [2, 50])
def test_many_contexts_of_one_anchor(spark, limit):
    random.seed(9)
    core = "".join(random.choice("abcdefgh") for _ in range(150))
    rows = []
    for k in range(40):
        left = "".join(random.choice("xy") for _ in range(9)) + "L" * random.randrange(70)
        right = "R" * random.randrange(80) + "".join(random.choice("uv") for _ in range(9))
        rows.append((k, left + core + right + "".join(random.choice("mnop") for _ in range(60))))
    data = [t.encode() for _, t in rows]
    times = {}
    for b in data:
        for i in range(len(b) - 199):
            times[b[i : i + 200]] = times.get(b[i : i + 200], 0) + 1
    want = {}
    for (d, _), b in zip(rows, data):
        gone = {j for i in range(len(b) - 199) if times[b[i : i + 200]] > 1 for j in range(i, i + 200)}
        want[d] = len(gone)
    assert any(want.values())
    got = substring_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), limit).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == want


def test_substring_dedup_keeps_columns_whatever_their_names(spark):
    text = "".join(random.choice("abc") for _ in range(300))
    docs = spark.createDataFrame([(1, text, 7, "r"), (2, text, 8, "q"), (3, "other", 9, None)], "doc_id bigint, text string, r int, ranges string")
    assert sorted(map(tuple, substring_dedup.dedup(docs).collect())) == [(1, "", 7, "r"), (2, "", 8, "q"), (3, "other", 9, None)]


# --- 7: SimHash ----------------------------------------------------------------------------


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize(("hot", "distance", "segments"), [(64, 2, 2), (2, 2, 2), (2, 1, 2), (3, 3, 4), (64, 4, 4)])
def test_links_are_all_pairs(spark, monkeypatch, hot, distance, segments):
    monkeypatch.setattr(simhash, "HOT", hot)
    random.seed(8)
    base = [random.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in random.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 5) for _ in range(5)}
    fps |= {(base[0] & 0xFFFFFFFF) | (random.getrandbits(32) << 32) for _ in range(30)} | {0, (1 << 64) - 1, 1 << 63}
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), distance, segments).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance}
    assert got == want


def test_rows_that_share_an_id_are_kept_apart(spark):
    rows = [(1, "one text about the sea and the wind over it"), (1, "quite another story of a mountain far away"), (2, "one text about the sea and the wind over it"), (None, "no id here at all my friend"), (None, "no id here at all my friend")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted({rows[0], rows[1], rows[3]}, key=str)


# --- 8: toxicity ---------------------------------------------------------------------------


def test_segments_equal_the_best_again_and_again():
    def best(scores, lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (top is None or total > top[0] + 1e-9):
                    top = (total, i, j)
        return [] if top is None else best(scores, lo, top[1]) + [(top[1], top[2], round(top[0], 6))] + best(scores, top[2] + 1, hi)

    random.seed(2)
    for _ in range(500):
        words = [random.choice("xyaab") for _ in range(random.randint(0, 14))]
        model = toxicity.Model({"x": random.choice([3.1, 2.03]), "y": 1.017}, other=-1.3)
        assert [(a, b, round(s, 6)) for a, b, s in model.segments(words)] == best([model.of(w) or model.other for w in words], 0, len(words))


def test_the_scan_is_linear():
    model = toxicity.Model({"x": 1.0}, other=-1.0)
    for words in (["x", "a", "a"] * 100_000, ["x"] * 100_000 + ["a"] * 100_000, ["x", "x", "a"] * 70_000):
        assert seconds(lambda w=words: model.segments(w)) < 3


def test_evidence_is_not_cut_off():
    model = toxicity.Model({"x": 5.0}, other=-1.0)
    few, many = (model.evidence([20.0] * n, 1000)[0] for n in (5, 500))
    assert many > few and model.evidence([4000.0], 1000)[1] > 3000
    assert model.surprise(-50.0, 10**6) == 0.0 and math.isfinite(model.surprise(1e6, 1))


def test_scores_of_odd_rows(spark, docs, none):
    texts = spark.createDataFrame([(k, "words of no weight " * 4 + "vile wretch " * (k % 3 == 0)) for k in range(300)], "doc_id bigint, text string")
    model = toxicity.fit(texts, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id bigint, toxic int"))
    nothing = model.probability("")
    got = {(r["doc_id"], r["score"]) for r in toxicity.scored(docs, model).collect()}
    assert {d for d, s in got if s == nothing} >= {1, 2, 3} and all(0 <= s <= 1 for _, s in got)
    assert model.probability("vile wretch") > 0.5 > nothing
    assert model.probability("filler word " * 20_000 + "vile wretch vile wretch") > nothing
    assert toxicity.without_toxic(docs, model).columns == docs.columns and toxicity.without_toxic(none, model).count() == 0
    assert toxicity.toxic_passages(docs, model).count() == 0


# --- 9: quality ----------------------------------------------------------------------------


def test_posteriors_equal_a_plain_version(spark):
    random.seed(6)
    rows = [(k, random.choice(["a", "b", None]), random.choice(["x", "y", None]), random.betavariate(2, 1 + k % 3)) for k in range(200)]
    got = {r["doc_id"]: (r["site"], r["quality"]) for r in quality.posteriors(spark.createDataFrame(rows, "doc_id bigint, host string, path string, own double")).collect()}
    centre = sum(r[3] for r in rows) / len(rows)
    hosts, paths = {}, {}
    for _, h, p, own in rows:
        hosts.setdefault(h, []).append(own)
        paths.setdefault((h, p), []).append(own)

    def strength(groups):  # (values, centre)
        groups = [(v, c) for v, c in groups if len(v) > 1]
        seen = sum(len(v) * (sum(v) / len(v) - c) ** 2 for v, c in groups)
        chance, scale = sum(c * (1 - c) for _, c in groups), sum(len(v) * c * (1 - c) for v, c in groups)
        return min(1e6, max(1.0, 1 / max(1e-6, (seen - chance) / scale) - 1))

    k_host = strength([(v, centre) for v in hosts.values()])
    k_path = strength([(v, sum(hosts[h]) / len(hosts[h])) for (h, _), v in paths.items()])
    for d, h, p, own in rows:
        host = (sum(hosts[h]) - own + centre * k_host) / (len(hosts[h]) - 1 + k_host)
        site = (sum(paths[h, p]) - own + host * k_path) / (len(paths[h, p]) - 1 + k_path)
        odds = math.log(own / (1 - own)) + math.log(site / (1 - site)) - math.log(centre / (1 - centre))
        assert got[d] == (pytest.approx(site), pytest.approx(1 / (1 + math.exp(-odds))))


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id bigint, quality int")
    got = quality.scored(docs, labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang")).collect()
    assert len(got) == docs.count() and all(0 <= r["quality"] <= 1 for r in got)
    assert len({(r["own"], r["site"], r["quality"]) for r in got if r["doc_id"] == 6}) == 1  # equal rows
