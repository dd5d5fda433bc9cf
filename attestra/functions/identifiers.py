"""Identifier formats, masks, fingerprints and deterministic ids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of identifiers.
FORMATS = {
    "GSTIN": "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$",
    "PAN": "^[A-Z]{5}[0-9]{4}[A-Z]$",
    "UDYAM": "^UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}$",
    "DPIIT": "^(DIPP|DPIIT)?[0-9A-Z]{4,25}$",
    "UAN": "^[0-9]{10,12}$",
    "ESIC": "^[0-9]{10,17}$",
    "MOBILE": "^[0-9]{10}$",
    "SCHEME_CERTIFICATE": "^[A-Z0-9]{5,30}$",
    "PENSION_ORDER": "^[A-Z0-9]{5,30}$",
    "BIRTH_DATE": "^[0-9]{2}-[0-9]{2}-[0-9]{4}$",
}


def is_valid(kind: str, c: Column) -> Column:
    return F.coalesce(F.regexp_like(F.upper(F.trim(c)), F.lit(FORMATS[kind])), F.lit(False))


def formats(c: Column) -> Column:
    """The kinds whose format a value has, comma-joined."""
    return F.concat_ws(",", *[F.when(is_valid(k, c), k) for k in FORMATS])


FORMATS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(upper(trim(value)), '{p}') THEN '{k}' END" for k, p in FORMATS.items()) + ")"


def pan_of(gstin: Column) -> Column:
    return F.when(F.length(F.trim(gstin)) == 15, F.substring(F.upper(F.trim(gstin)), 3, 10))


def state_of(gstin: Column) -> Column:
    return F.when(F.length(F.trim(gstin)) == 15, F.substring(F.trim(gstin), 1, 2))


def _shown(c: Column, first: int, mask: str, last: int, least: int, short: str) -> Column:
    """The first and last characters of an identifier of ``least`` or more, else ``short``."""
    x = F.upper(F.trim(c))
    middle = F.concat(F.substring(x, 1, first) if first else F.lit(""), F.lit(mask), F.right(x, F.lit(last)))
    return F.when(F.coalesce(c, F.lit("")) == "", "none").when(F.length(x) >= least, middle).otherwise(short)


#: By kind of identifier: characters shown in front, the mask, characters shown behind, the least length, what shorter ones become.
MASKS = {
    "GSTIN": (6, "****", 5, 10, "****"), "PAN": (5, "***", 2, 10, "****"), "UDYAM": (12, "***", 4, 15, "****"), "MOBILE": (0, "******", 4, 10, "******"),
    "DPIIT": (4, "****", 4, 8, "****"), "EPFO": (4, "****", 4, 8, "****"), "ESIC": (4, "****", 4, 8, "****"), "SENSITIVE": (0, "***", 4, 5, "****"),
}


def masked(c: Column, kind: str) -> Column:
    return _shown(c, *MASKS[kind])


def all_masks(c: Column) -> Column:
    """An identifier as each kind masks it."""
    return F.concat_ws(",", *[masked(c, k) for k in MASKS])


MASKS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN coalesce(value, '') = '' THEN 'none' WHEN length(trim(value)) >= {n} THEN substring(upper(trim(value)), 1, {a}) || '{m}' || right(upper(trim(value)), {b}) ELSE '{s}' END" for a, m, b, n, s in MASKS.values()) + ")"


def fingerprint(c: Column, digits: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def run_id(*parts: str) -> Column:
    return F.concat(F.lit("RUN-"), F.upper(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12)))


def block_node_id(document: Column, page: Column, block_id: Column, snippet: Column) -> Column:
    """By block id, else by page and a hash of the snippet, else by page alone."""
    at = F.concat_ws(":", F.lit("BLOCK"), document)
    return F.coalesce(F.when(block_id.isNotNull(), F.concat_ws(":", at, block_id)), F.when(snippet.isNotNull(), F.concat_ws(":", at, page, fingerprint(snippet, 10))), F.concat_ws(":", at, page, F.lit("PRIMARY")))


#: Words in the names of details: hashed, redacted, masked.
HASHED, REDACTED, MASKED = ("token", "secret", "signature", "key"), ("authorization", "password", "cookie", "api-key", "apikey"), ("identifier", "pan", "gstin", "udyam", "mobile", "aadhaar")


def sanitized(details: Column) -> Column:
    """A map of details without what must not be logged: credentials redacted, secrets hashed, identifiers masked; the rest stays."""
    named = lambda k, words: F.regexp_like(F.lower(k), F.lit("|".join(words)))
    return F.transform_values(details, lambda k, v: F.when(named(k, REDACTED), F.lit("[REDACTED]")).when(named(k, HASHED), fingerprint(v, 12)).when(named(k, MASKED), F.when(F.length(F.trim(v)) > 4, F.concat(F.lit("***"), F.right(F.trim(v), F.lit(4)))).otherwise("****")).otherwise(v))


def canonical_json(**columns: Column) -> Column:
    """JSON with keys in alphabetical order and no white space; decimals and floats come as what they are given as, see ``six_places``."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def six_places(c: Column) -> Column:
    """A number rounded to six places."""
    return F.round(c.cast("double"), 6)
