"""Block-level text jobs: fact extraction, quality gates, grounding, candidate merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import normalize

# Patterns of facts in block text by field, words that carry no meaning, and patterns of procurement text.
FACT_PATTERNS = {
    "gstin": r"(\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}[Z]{1}[A-Z\d]{1}\b)",
    "pan": r"(\b[A-Z]{5}\d{4}[A-Z]{1}\b)",
    "warranty_years": r"(?:warranty|guarantee)\s*(?:period)?\s*[:=-]?\s*(\d+)\s*(?:years?|yrs?|months?)",
    "turnover_cr": r"(?:turnover|revenue)\s*[:=-]?\s*(?:inr|rs\.?|₹)?\s*(\d+(?:\.\d+)?)\s*(?:crores?|cr|lakhs?|lakh)?",
    "delivery_days": r"(?:delivery|lead\s*time)\s*[:=-]?\s*(\d+)\s*days?",
    "iso_cert": r"\b(ISO\s*\d{4,5}(?::\d{4})?)\b",
}
STOP_WORDS = ("the", "and", "of", "for", "with", "shall", "must", "is", "are", "in", "to", "a", "an", "on", "at", "by", "from", "as", "be", "this", "that", "it", "or")
CLAIM_WORDS = ("status", "compliance", "undertaking", "confirmation", "cert", "certificate", "declared", "declaration")
TOKEN_PATTERNS = (
    r"\b\d+(?:[.,]\d+)?\s*(?:%|cr|crore|lakh|inr|rs|days|months|years|qty|nos|meters)?\b",
    r"\b(?:tender|bid|bidder|gem|gst|gstin|pan|cin|udyam|oem|nsic|clause|turnover|experience|delivery)\b",
    r"\b(?:compliance|specification|technical|financial|schedule|section|annexure|declaration)\b",
    r"\b(?:pvt|ltd|limited|corporation|enterprises|solutions|technologies|company)\b",
    r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b",
)
# How durations, amounts, numbers and words stand in a text, which fields are of which family, and words that affirm or deny.
DURATION_PHRASE = r"\b(?:\d+(?:\.\d+)?|zero|one|two|three|four|five|six|seven|eight|nine|ten)\s*(?:years?|yrs?|yr|months?|mths?|mth|mo|days?|d)\b"
AMOUNT_PHRASE = r"\d+(?:[.,]\d+)?\s*(?:crores?|crs?|lakhs?|lacs?|millions?|thousands?|k|m|cr|%)?"
DURATION_UNIT = r"\b(years?|yrs?|yr|months?|mths?|mth|mo|days?|d)\b"
NUMBER_TOKEN, SIGNED_NUMBER, WORD_TOKEN = r"[-+]?[\d.]+", r"[-+]?\d+(?:\.\d+)?", r"\b[A-Za-z0-9]+(?::[A-Za-z0-9]+)?\b"
IDENTIFIER_FIELDS = ("gstin", "pan", "udyam", "cin", "registration", "cert_number")
DURATION_FIELDS = ("warranty", "experience", "validity", "delivery", "duration")
FLAG_PREFIX = "^(is_|has_|are_)"
NEGATIONS = r"\b(not|unauthorized|non-compliant|ineligible|rejected|disqualified)\b"
AFFIRMATIVES = ("yes", "confirmed", "submitted", "available", "compliant")
LEAST_IDENTIFIER, LEAST_NAME, LEAST_WORD, PARTLY, MOSTLY = 3, 3, 2, 0.5, 0.75
# Document types by part of the path, beginning of the file name, pattern in the file name, and words at the head of the text; the first that holds decides.
DOCUMENT_TYPES = (
    ("TENDER", "/tenders/", "tender-", None, None),
    ("BID", "/bids/", "bid-", None, None),
    ("TENDER", None, None, "^gem_|^nit|tender", None),
    ("TECHNICAL_BID", None, None, "technical|tech_bid", "technical bid"),
    ("FINANCIAL_BID", None, None, "financial|boq|price_bid", None),
    ("CERTIFICATE", None, None, "cert|udyam|iso|pan|gst", None),
    ("DECLARATION", None, None, "decl|undertaking|affidavit", None),
)
UNPRINTABLE = r"[\x00-\x08\x0E-\x1F\x7F]"
SHORT_PAGE = 20


def extract(blocks: DataFrame, text: str = "text", patterns: dict[str, str] = FACT_PATTERNS) -> DataFrame:
    """``blocks`` with a row for each pattern that a block matches: field and what its first match names."""
    found = F.array(*[F.struct(F.lit(k).alias("field"), F.regexp_extract(text, f"(?i){p}", 1).alias("found")) for k, p in patterns.items()])
    return blocks.withColumn("x", F.explode(F.filter(found, lambda x: x["found"] != ""))).select(*blocks.columns, "x.*")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _share(text: Column, pattern: str) -> Column:
    """How much of a text's characters match a pattern of one character."""
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def quality(text: Column, *, ocr: Column | None = None) -> tuple[Column, Column]:
    """(score, confidence) of a page: by length and printable characters, or from the recogniser's own confidence for scans."""
    clean = _stripped(text)
    n = F.length(clean)
    printable = 1 - F.try_divide(F.regexp_count(clean, F.lit(UNPRINTABLE)), n)
    base = F.when((n >= 80) & (printable >= 0.85), 0.95).when(n >= 20, 0.70).otherwise(0.35)
    if ocr is not None:
        read = F.greatest(F.lit(0.2), F.least(F.lit(1.0), ocr))
        base = F.when(ocr.isNotNull(), F.when(n < 20, read * 0.5).otherwise(read)).otherwise(base)
    score = F.when(n == 0, 0.0).otherwise(base * printable)
    return F.round(score, 4), F.when(score >= 0.80, "HIGH").when(score >= 0.50, "MEDIUM").otherwise("LOW")


def longest_run_share(text: Column) -> Column:
    """The longest run of one character over the length; 0 for an empty text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)\1+"), F.lit(0)), F.length)  # of two or more: a match for every character would be as many as the text has
    return F.round(F.coalesce(F.array_max(runs), F.when(F.length(text) > 0, 1), F.lit(0)) / F.greatest(F.lit(1), F.length(text)), 6)


def _measures(clean: Column) -> dict[str, Column]:
    """What ``validity`` is made of: length, share of printable characters, of letters and digits, of the longest run, and patterns found."""
    n, hits = F.length(clean), F.lit(0)
    for p in TOKEN_PATTERNS:
        hits = hits + F.regexp_like(clean, F.lit(f"(?i){p}")).cast("int")
    return {"n": n, "printable": 1 - F.try_divide(F.regexp_count(clean, F.lit(UNPRINTABLE)), n), "letters": F.try_divide(F.regexp_count(clean, F.lit(r"[\p{L}\p{N}]")), n), "run": longest_run_share(clean), "hits": hits}


def _judged(of: dict[str, Column], confidence: Column) -> tuple[Column, Column]:
    n, printable, letters, run = of["n"], of["printable"], of["letters"], of["run"]
    tokens = F.when(n < 10, 0.0).otherwise(F.least(F.lit(1.0), of["hits"] / 3.0))
    sure = F.greatest(F.lit(0.1), F.least(F.lit(1.0), confidence))
    whole = (0.35 * sure + 0.25 * letters + 0.25 * tokens + 0.15 * F.least(F.lit(1.0), n / 150.0)) * printable
    composite = F.when(n == 0, 0.0).otherwise(F.when(run > 0.35, whole * 0.5).otherwise(whole))
    failed = (n < 10) | (printable < 0.70) | (letters < 0.20) | (run > 0.50) | (composite < 0.25)
    low = (n < 30) | (letters < 0.40) | (sure < 0.50) | (composite < 0.50)
    return F.round(composite, 6), F.when(n == 0, "FAILED").when(failed, "FAILED").when(low, "LOW_CONFIDENCE").otherwise("ACCEPTED")


def validity(text: Column, confidence: Column) -> tuple[Column, Column]:
    """(composite, status) of recognised text: letters and digits, procurement patterns, length and confidence, halved for long runs of one character."""
    return _judged(_measures(_stripped(text)), confidence)


def _any(parts: Column, test) -> Column:
    return F.coalesce(F.exists(parts, test), F.lit(False))


def _first(*outcomes: tuple[Column | None, str]) -> Column:
    """The name of the first outcome whose condition holds; the last one has none."""
    out = F.lit(outcomes[-1][1])
    for condition, name in reversed(outcomes[:-1]):
        out = F.when(condition, name).otherwise(out)
    return out


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def _phrases(text: Column, pattern: str) -> Column:
    """The different parts of a text that a pattern finds, with a space between number and unit."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"([0-9])\s*([a-z%])", "$1 $2")))


def _let(c: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` reads it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def support(value: Column, field: Column, text: Column) -> Column:
    """How a text supports a claimed value of a field; ``SUPPORTED`` has the outcomes that do.

    Each family of values has its own outcomes: identifiers are looked for as letters and digits
    alone, durations and amounts as equal quantities, booleans by the words of the field without
    a negation, and other texts as a whole, else by three quarters of their words, codes among
    them all.  What a value and each phrase of the text stand for is read once.
    """
    v, f, low, flag = F.trim(value), F.lower(field), F.lower(text), normalize.boolean(F.trim(value))
    lasts = lambda c: _let(normalize.spelled(c), lambda t: F.struct(normalize.lasts(t, "MONTHS").alias("months"), normalize.lasts(t, "DAYS").alias("days")))
    amount = lambda c: _let(normalize.bare(c), lambda b: _let(normalize.scale(b), lambda k: _let(normalize.plain(b, k), lambda p: normalize.number(p, k))))
    of_field = lambda words: F.regexp_like(f, F.lit("|".join(words)))
    count = lambda parts, test: F.size(F.filter(parts, test))
    in_text = lambda t: F.contains(low, t)
    number = F.regexp_extract(v, SIGNED_NUMBER, 0)
    named = F.filter(F.split(F.regexp_replace(f, FLAG_PREFIX, ""), r"[_\s\-]+"), lambda t: (F.length(t) >= LEAST_NAME) & ~t.isin(*STOP_WORDS, *CLAIM_WORDS))
    words = F.filter(F.regexp_extract_all(F.lower(v), F.lit(WORD_TOKEN), F.lit(0)), lambda t: (F.length(t) >= LEAST_WORD) & ~t.isin(*STOP_WORDS))
    denied = F.regexp_like(low, F.lit(NEGATIONS))

    def of_names(names: Column) -> Column:
        seen, all_named, nameless = count(names, in_text), F.size(names), F.size(names) == 0
        return _first(
            (nameless & F.regexp_like(low, F.lit("|".join(AFFIRMATIVES))), "AFFIRMATIVE_WORD_FOUND"), (nameless, "BOOLEAN_UNSUPPORTED"), ((seen == all_named) & denied, "NEGATED_BOOLEAN"), (seen == all_named, "BOOLEAN_AFFIRMED"),
            ((seen > 0) & (seen / all_named >= PARTLY), "BOOLEAN_PARTIAL_AFFIRMED"), (None, "BOOLEAN_UNSUPPORTED"),
        )

    def of_words(some: Column) -> Column:
        return _first(
            (in_text(F.lower(v)), "EXACT_SUBSTRING_MATCH"), (F.size(some) == 0, "NO_SUBSTANTIVE_TOKENS"), (count(some, lambda t: F.regexp_like(t, F.lit("[0-9:]")) & ~in_text(t)) > 0, "CODE_MISMATCH"),
            (count(some, in_text) / F.size(some) >= MOSTLY, "TOKEN_CONTAINMENT_MATCH"), (None, "TEXT_UNSUPPORTED"),
        )

    identifier = _let(_letters(v), lambda own: _first(((F.length(own) >= LEAST_IDENTIFIER) & F.contains(_letters(text), own), "EXACT_IDENTIFIER_MATCH"), (None, "IDENTIFIER_MISMATCH")))
    as_duration = lambda d: _first((_any(_phrases(low, DURATION_PHRASE), lambda x: _let(lasts(x), lambda e: (e["months"] == d["months"]) | (e["days"] == d["days"]))), "DURATION_NORMALIZED_MATCH"), (None, "DURATION_MISMATCH"))
    as_amount = lambda a: _first((_any(_phrases(low, AMOUNT_PHRASE), lambda x: amount(x) == a), "CURRENCY_MATCH"), ((number != "") & F.array_contains(F.regexp_extract_all(low, F.lit(NUMBER_TOKEN), F.lit(0)), number), "NUMERIC_TOKEN_MATCH"), (None, "NUMERIC_MISMATCH"))
    other = F.when(flag, _let(named, of_names)).when(~flag, "BOOLEAN_NEGATIVE_ACCEPTED").otherwise(_let(words, of_words))
    measured = _let(amount(v), lambda a: F.when(a.isNotNull(), as_amount(a)).otherwise(other))
    duration = F.when(of_field(DURATION_FIELDS) | F.regexp_like(F.lower(v), F.lit(DURATION_UNIT)), lasts(v))
    quantity = _let(duration, lambda d: F.when(d["months"].isNotNull() | d["days"].isNotNull(), as_duration(d)).otherwise(measured))
    return F.when(value.isNull() | (v == ""), "EMPTY_VALUE").when(of_field(IDENTIFIER_FIELDS), identifier).otherwise(quantity)


SUPPORTED = (
    "EXACT_IDENTIFIER_MATCH", "DURATION_NORMALIZED_MATCH", "CURRENCY_MATCH", "NUMERIC_TOKEN_MATCH", "BOOLEAN_AFFIRMED", "BOOLEAN_PARTIAL_AFFIRMED", "AFFIRMATIVE_WORD_FOUND", "BOOLEAN_NEGATIVE_ACCEPTED", "EXACT_SUBSTRING_MATCH", "TOKEN_CONTAINMENT_MATCH",
)


def ground(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """(candidate_id, grounded, n_blocks, resolved) for candidates (candidate_id, doc_id, block_ids): one unknown id fails the candidate.

    ``resolved`` has the known blocks in the order of the ids, each once, with their texts.
    """
    each = candidates.select("candidate_id", "doc_id", F.posexplode(F.array_distinct("block_ids")).alias("place", "block_id"))
    known = blocks.select("doc_id", "block_id", "page_number", F.col("text").alias("block_text"), F.lit(True).alias("known"))
    resolved = F.sort_array(F.collect_list(F.when(F.col("known"), F.struct("place", "block_id", "page_number", "block_text"))))
    return each.join(known, ["doc_id", "block_id"], "left").groupBy("candidate_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("grounded"), F.count("*").alias("n_blocks"), resolved.alias("resolved"))


def typed(field: Column, value: Column) -> Column:
    return F.when(field == "turnover_cr", normalize.amount(F.concat(value, F.lit(" crore"))).cast("double")).otherwise(value.try_cast("double"))


def page_box(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float) -> Column:
    """A box as [ymin, xmin, ymax, xmax], clipped to the page, ends put in order, two decimals."""
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), c.cast("double")))
    xs, ys = (clip(x0, width), clip(x1, width)), (clip(y0, height), clip(y1, height))
    return F.array(*[F.round(v, 2) for v in (F.least(*ys), F.least(*xs), F.greatest(*ys), F.greatest(*xs))])


def valid_box(box: Column, width: float, height: float) -> Column:
    return F.when(F.size(box) != 4, "SIZE").when(F.exists(box, lambda v: v < 0), "NEGATIVE").when((box[2] <= box[0]) | (box[3] <= box[1]), "ORDER").when((box[2] > height) | (box[3] > width), "BOUNDS").otherwise("OK")


def document_type(path: Column, text: Column) -> Column:
    """The type of a document by its folder, its file name, and the first 300 characters of its text."""
    low, head = F.lower(path), F.lower(F.substring(text, 1, 300))
    name = F.substring_index(low, "/", -1)
    out = F.lit("UNKNOWN")
    for kind, folder, opening, pattern, said in reversed(DOCUMENT_TYPES):
        holds = F.lit(False)
        for words, test in ((folder, lambda w: F.contains(low, F.lit(w))), (opening, name.startswith), (pattern, lambda w: F.regexp_like(name, F.lit(w))), (said, lambda w: F.contains(head, F.lit(w)))):
            holds = holds | test(words) if words else holds
        out = F.when(holds, kind).otherwise(out)
    return out


def candidates(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows of fenced JSON payloads; a payload that cannot be read gives none."""
    bare = F.regexp_replace(payload, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    whole = F.when(bare.startswith("[") & bare.endswith("]"), F.from_json(bare, schema))
    return df.select(F.explode(whole).alias("x")).select("x.*")


def best_version(versions: DataFrame) -> DataFrame:
    """(doc_id, page_number, pass, method, text, n_chars, score) of ``versions`` (doc_id, page_number, pass, text, sure, success): the text to take for each page.

    Pass 0 is what the file itself holds.  Of the recogniser's passes that succeeded and are valid
    text, the one with the highest composite score is the best, of equal ones the earlier; it is
    taken if it is longer than the file's own text, or if that is too short to be a page's.
    """
    # Texts are measured in a step of their own, once each, and only those that can be taken: conditions would read them again for every use.
    tried = (F.col("pass") > 0) & F.col("success")
    stripped = versions.withColumn("_clean", _stripped(F.coalesce("text", F.lit(""))))
    known = _measures(F.col("_clean"))
    measured = stripped.withColumns({f"_{k}": F.when(tried & F.col("text").isNotNull(), c) for k, c in known.items()}).withColumn("n_chars", F.length("_clean").cast("long"))
    composite, status = _judged({k: F.col(f"_{k}") for k in known}, F.coalesce("sure", F.lit(0.0)))
    scored = measured.withColumns({"score": composite, "valid": status != "FAILED"})
    read = tried & F.col("valid")
    shown = F.struct("pass", "text", "n_chars", "score")
    met = scored.groupBy("doc_id", "page_number").agg(F.max_by(F.when(F.col("pass") == 0, shown), F.when(F.col("pass") == 0, 1)).alias("own"), F.max_by(F.when(read, shown), F.when(read, F.struct("score", -F.col("pass")))).alias("best"))
    taken = F.col("best").isNotNull() & (F.col("own").isNull() | (F.col("best.n_chars") > F.col("own.n_chars")) | (F.col("own.n_chars") < SHORT_PAGE))
    out = F.when(taken, F.col("best")).otherwise(F.struct(F.lit(0).alias("pass"), F.col("own.text").alias("text"), F.coalesce("own.n_chars", F.lit(0)).alias("n_chars"), F.lit(None).cast("double").alias("score")))
    return met.select("doc_id", "page_number", out.alias("x"), F.when(taken, "OCR").otherwise("NATIVE_PDF").alias("method")).select("doc_id", "page_number", "method", "x.*")


def document_rollup(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_chars, method, confidence) of the pages taken: how their text came about, and the worst confidence among them."""
    n, ocr = F.col("n_chars"), F.col("method") == "OCR"
    sure = F.when(n < SHORT_PAGE, "LOW").when(n < 80, "MEDIUM").when(~ocr | (F.col("score") >= 0.8), "HIGH").when(F.col("score") >= 0.5, "MEDIUM").otherwise("LOW")
    method = F.when(F.bool_and(ocr), "OCR").when(F.bool_or(ocr), "HYBRID").otherwise("NATIVE_PDF")
    worst = F.when(F.bool_or(F.col("sure") == "LOW"), "LOW").when(F.bool_or(F.col("sure") == "MEDIUM"), "MEDIUM").otherwise("HIGH")
    return pages.withColumn("sure", sure).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("n_chars").alias("n_chars"), method.alias("method"), worst.alias("confidence"))
