"""Each operator against a plain version, on texts with nulls, ties, repeats and clashing columns, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from attestra.llm import bpe, decontaminate, fingerprint, html_text, line_dedup, quality, simhash, storage, substring_dedup, suffix_array, token_store, toxicity
from attestra.llm.queries import vocabulary_path


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_token_store(spark, docs, none, tokenizer):
    path = storage.new_path(spark, "store")
    token_store.write_store(docs, vocabulary_path(), path)
    got = sorted(map(tuple, token_store.with_crc(token_store.read_store(spark, path)).collect()), key=lambda r: r[1])
    at, want = 0, []
    for d, t in sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert got == want
    assert {r["doc_id"] for r in token_store.lookup(spark, path, [0, 8]).collect()} == {0, 8}
    empty = storage.new_path(spark, "store")
    token_store.write_store(none, vocabulary_path(), empty)
    assert token_store.read_store(spark, empty).count() == 0


def test_bpe(docs, none, tokenizer):
    want = Counter((d, len(i := tokenizer.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, t in rows_of(docs))
    assert Counter(map(tuple, bpe.digests(docs, vocabulary_path()).collect())) == want
    back = bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path())
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())
    assert bpe.digests(none, vocabulary_path()).count() == 0


@pytest.mark.parametrize("text", ["", " ", "\n", "a  b \n\n c\t d", "<|endoftext|> x<|endoftext|>", "it's we'll ½ ² １２\x85 a\x1c b", "a" * 40, "🎉é" * 9, " \n " * 9 + "x", "x\x01 y", "a　b"])
def test_bpe_of_odd_texts(tokenizer, text):
    with open(vocabulary_path(), encoding="utf-8") as f:
        trie = bpe.TrieBpe(f.read())
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert trie.encode(text) == ids and trie.decode(ids) == text


def test_fingerprint(docs, none):
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = Counter()
    for k, (d, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.digest(t.encode()).hex()] += 1
    got = fingerprint.edited_neighbours(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got) == want
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert fingerprint.edited_neighbours(none).count() == 0


def test_simhash(docs, none):
    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = [(d, plain(t)) for d, t in rows_of(docs)]
    component = dict.fromkeys({f for _, f in rows})
    for f in component:
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            near = [g for g in component if g not in seen and (g ^ x).bit_count() <= 2]
            seen.update(near)
            todo += near
        component[f] = min((d for d, g in rows if g in seen and d is not None), default=None)
    want = Counter((d, f"{f:016x}", component[f]) for d, f in rows)
    assert Counter(map(tuple, simhash.components(docs).select("doc_id", simhash.hexed(), "component_id").collect())) == want
    groups = {}  # which component each text is in, by its least fingerprint
    for f in component:
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            near = [g for g in component if g not in seen and (g ^ x).bit_count() <= 2]
            seen.update(near)
            todo += near
        groups[f] = min(seen)
    kept = [(r["doc_id"], groups[plain(r["text"])]) for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(groups.values())) and {g for _, g in kept} == set(groups.values())
    assert all(d == component[g] for d, g in kept)
    assert simhash.components(none).count() == 0


def test_links_join_what_pairs_would(spark):
    import random

    random.seed(3)
    base = [random.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in random.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(6)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
    neighbours = {}
    for a, b in found:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    for a in fps:
        for b in fps:
            if 0 < (a ^ b).bit_count() <= 2:
                seen, todo = {signed(a)}, [signed(a)]
                while todo:
                    new = neighbours.get(todo.pop(), set()) - seen
                    seen |= new
                    todo += new
                assert signed(b) in seen


def test_suffix_array():
    import random

    random.seed(1)
    for _ in range(400):
        x = [random.randint(0, random.choice([1, 2, 9])) for _ in range(random.randint(0, 40))]
        assert suffix_array.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("limit", [1000, 1])
def test_substring_dedup(docs, none, limit):
    rows = [(d, (t or "").encode()) for d, t in rows_of(docs)]
    times = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = Counter()
    for d, b in rows:
        gone, end = set(), 0
        for i in range(len(b)):
            if i <= len(b) - 200 and times[b[i : i + 200]] > 1:
                end = i + 200
            if i < end:
                gone.add(i)
        want[d, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in gone)).hexdigest()] += 1
    assert Counter(map(tuple, substring_dedup.digests(docs, limit).collect())) == want
    assert substring_dedup.digests(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(f"Shared{k}" for k in range(5, 25))), (2, "café"), (3, None), (4, "not there at all"), (5, " ".join(f"shared{k}" for k in range(30, 41))), (6, "")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = Counter()
    for d, t in rows_of(docs):
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[s : s + n]:
                        hit.update(range(i, i + n))
                        found.add(str(item))
        want[d, len(w), len(hit), ",".join(sorted(found)), bool(hit)] += 1
    got = decontaminate.contamination(docs, benchmark)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"]), r["contaminated"]) for r in got.collect()) == want
    assert decontaminate.clean(docs, benchmark).count() == sum(n for k, n in want.items() if not k[4])
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())
    near = decontaminate.proximity(docs, spark.createDataFrame([(1, "lazy fox")], "query_id int, text string"), 6)
    assert {(r["doc_id"], r["pos"]) for r in near.collect()} == {(0, 3)}


def test_line_dedup(docs, none):
    rows = sorted({(d if d is not None else 1 << 62, t) for d, t in rows_of(docs) if t is not None})
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows.sort(key=lambda r: (r[0], hashed[r[1]]))
    first, gone = set(), set()
    for d, t in rows:
        lines = t.split("\n")
        for i in range(len(lines)):
            own = [(tuple(lines[i : j + 1]), j) for j in range(i, len(lines)) if sum(map(len, lines[i : j + 1])) >= 200]
            for run, j in own:
                if run in first:
                    gone.update((d, t, k) for k in range(i, j + 1))
            first.update(run for run, _ in own)
    want = Counter((d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d if d is not None else 1 << 62, t, k) not in gone)) for d, t in rows_of(docs))
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert line_dedup.dedup(none).count() == 0


def test_html_text(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>One <b>two</b> three.<br>Four<p>Five</article><aside>side</aside><div id="comments"><p>me too</p></div><footer>&copy; x</footer>'
    assert html_text.main_text(page) == "A & B One two three. Four Five"
    plain = "<body><div class='menu'>Home</div><div><p>A long paragraph of text here.</p><p>Another one follows.</p></div><form>Search</form></body>"
    assert html_text.main_text(plain) == "A long paragraph of text here. Another one follows."
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", page), (3, "u", page), (4, "u", "<article><p>cut of")], "page_id bigint, url string, html string")
    assert sorted((r["page_id"], r["n_chars"]) for r in html_text.extract(rows).collect()) == [(1, 0), (2, 0), (3, 30), (3, 30), (4, 6)]
    assert html_text.extract(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = [(k, f"plain words number {k} about nothing " * 5 + ("you vile wretch and vile fool " * 3 if k % 5 == 0 else "") + ("!!$$ %%%% SHOUT ## " * 20 if k % 7 == 0 else ""), f"h{k % 3}", "p") for k in range(400)]
    labels = [(k, int(k % 7 != 0), int(k % 5 == 0)) for k in range(400)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, labelled, docs, none):
    texts, labels = labelled
    model = toxicity.fit(texts, labels)
    got = toxicity.scored(texts, model).filter("held_out").collect()
    assert got and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got)
    assert {r["doc_id"] for r in toxicity.toxic_passages(texts, model).collect()} == set(range(0, 400, 5))
    assert toxicity.without_toxic(texts, model).count() == 320
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.scored(none, model).count() == 0
    assert toxicity.fit(texts, labels.limit(0)).probability("vile") == 0.0


def test_maximal_segments():
    model = toxicity.Model({"x": 3.0, "y": 1.0}, other=-1.0)
    assert model.segments("x a a x b b b b b y".split()) == [(0, 3, 4.0), (9, 9, 1.0)]
    assert model.segments([]) == []


def test_quality(labelled, none):
    texts, labels = labelled
    got = quality.scored(texts, labels, host=F.col("source"), path=F.col("lang")).filter("held_out").collect()
    assert sum(r["keep"] == (r["doc_id"] % 7 != 0) for r in got) >= 0.97 * len(got)
    empty = quality.scored(none.select("doc_id", "text", "source", "lang"), labels.limit(0), host=F.col("source"), path=F.col("lang"))
    assert empty.count() == 0


SPACES = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　", "​", "﻿"]


def test_token_store_of_odd_texts(spark, tokenizer):
    import random

    rnd = random.Random(7)
    texts = [form.format(s) for s in SPACES for form in ("{0}", "{0}a", "a{0}", "{0} b c", "{0}{0}", " {0}x", "a {0}\n{0} b")]
    texts += ["".join(rnd.choice([*SPACES, "a", "B", "é", "1", "'s", "☕", ".", "\x01", "<|endoftext|>"]) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    path = storage.new_path(spark, "store")
    token_store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), vocabulary_path(), path)
    got = {r["doc_id"]: r["ids"] for r in token_store.read_store(spark, path).collect()}
    assert [texts[k] for k, ids in got.items() if ids != tokenizer.encode(texts[k], add_special_tokens=False).ids + [0]] == []


def test_token_store_where_line_ends_join_words(tokenizer):
    with open(vocabulary_path(), encoding="utf-8") as f:
        encoder = token_store._Encoder(f.read())
    encoder._encoded, joined = (lambda texts, encode=encoder._encoded: encode([t.replace("\n", "") for t in texts])), ["one", " two"]
    encoder._learn(joined)  # no line end is found: each piece is encoded alone
    assert [encoder.ids[encoder.begin[k] : encoder.begin[k] + encoder.size[k]].tolist() for k in (0, 1)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in joined]
