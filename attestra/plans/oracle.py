"""DuckDB twins: common table expressions for the bridge views and each step, put together on demand."""

from __future__ import annotations

import re

from attestra.functions.normalize import ABSENT_WORDS, FALSE_WORDS, NO_DATE_WORDS, NUMBER_WORDS, TRUE_WORDS
from attestra.operators.text import TOKEN_PATTERNS
from attestra.operators.resolve import ALIASES, AMBIGUOUS, NOT_COMPARED, PROFILE, SELF_MADE
from attestra.sources.bridge import REFERENCE_DATE, requirement_rows


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def amount(x: str) -> str:
    bare = f"trim(regexp_replace(lower(trim({x})), '[?₹]|rs\\.?|inr|rupees', '', 'g'))"
    words = (("crores?|crs?", 10_000_000), ("lakhs?|lacs?", 100_000), ("millions?|m", 1_000_000), ("thousands?|k", 1_000))
    has = lambda w: f"regexp_matches({bare}, '\\b({w})\\b')"
    rest = "CASE " + " ".join(f"WHEN {has(w)} THEN trim(regexp_replace({bare}, '\\b({w})\\b', '', 'g'))" for w, _ in words) + f" ELSE {bare} END"
    scale = "CASE " + " ".join(f"WHEN {has(w)} THEN {n}" for w, n in words) + " ELSE 1 END"
    plain = f"trim(replace({rest}, ',', ''))"
    left = f"regexp_replace({plain}, '[?$]|\\b(rs\\.?|inr|rupees|crores?|crs?|lakhs?|lacs?|millions?|thousands?|k|m|cr)\\b', '', 'g')"
    number = f"TRY_CAST(nullif(regexp_extract({plain}, '[-+]?\\d*\\.?\\d+', 0), '') AS DECIMAL(18,6))"
    return f"(CASE WHEN NOT regexp_matches({left}, '[a-zA-Z]') THEN CAST({number} AS DECIMAL(28,6)) * CAST({scale} AS DECIMAL(9,0)) END)"


def date(x: str) -> str:
    formats = "['%Y-%m-%d', '%d-%m-%Y', '%d/%m/%Y', '%Y/%m/%d', '%d-%b-%Y', '%d-%B-%Y', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%d-%m-%Y %H:%M:%S']"
    iso = f"try_strptime(nullif(regexp_extract({x}, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), ''), '%Y-%m-%d')"
    day_first = f"try_strptime(nullif(replace(regexp_extract({x}, '\\b(\\d{{2}}[-/]\\d{{2}}[-/]\\d{{4}})\\b', 1), '/', '-'), ''), '%d-%m-%Y')"
    return f"(CASE WHEN lower(trim({x})) NOT IN {_list(NO_DATE_WORDS)} THEN CAST(coalesce(try_strptime(trim({x}), {formats}), {iso}, {day_first}) AS DATE) END)"


def duration(x: str, unit: str = "MONTHS") -> str:
    text = f"lower(trim({x}))"
    for digit, word in enumerate(NUMBER_WORDS):
        text = f"regexp_replace({text}, '\\b({word})\\b', '{digit}', 'g')"
    n = f"TRY_CAST(nullif(regexp_extract({text}, '\\b(\\d+(?:\\.\\d+)?)\\b', 1), '') AS DECIMAL(18,6))"
    times = {"MONTHS": ("12", "1", "1/30"), "DAYS": ("365", "30", "1"), "YEARS": ("1", "1/12", "1/365")}[unit]

    def of(f: str) -> str:
        a, _, b = f.partition("/")
        return f"TRY_CAST(CAST({n} AS DOUBLE) * {a} / {b or 1} AS DECIMAL(18,6))"

    return f"(CASE WHEN regexp_matches({text}, '\\b(years?|yrs?|yr)\\b') THEN {of(times[0])} WHEN regexp_matches({text}, '\\b(months?|mths?|mth|mo)\\b') THEN {of(times[1])} WHEN regexp_matches({text}, '\\b(days?|d)\\b') THEN {of(times[2])} ELSE {n} END)"


def boolean(x: str) -> str:
    return f"(CASE WHEN lower(trim({x})) IN {_list(TRUE_WORDS)} THEN true WHEN lower(trim({x})) IN {_list(FALSE_WORDS)} THEN false END)"


def categorical(x: str) -> str:
    return f"upper(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def exists(x: str) -> str:
    return f"coalesce(lower(trim({x})) NOT IN {_list(ABSENT_WORDS)}, false)"


def field_key(x: str) -> str:
    low = f"regexp_replace(lower(trim({x})), '[\\s\\-./]+', '_', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({low}, '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


def legal_name(x: str) -> str:
    name = f"trim(regexp_replace(translate(upper(trim(coalesce({x}, ''))), '.,', '  '), '\\s+', ' ', 'g'))"
    for long, short in (("PRIVATE LIMITED", "PVT LTD"), ("LIMITED", "LTD"), ("L L P", "LLP"), ("INCORPORATED", "INC"), ("CORPORATION", "CORP")):
        name = f"regexp_replace({name}, '\\b{long}\\b', '{short}', 'g')"
    return name


def registry_name(x: str) -> str:
    name = f"trim(regexp_replace(upper(trim(coalesce({x}, ''))), '\\s+', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({name}, '\\bPVT\\.? LTD\\.?', 'PRIVATE LIMITED', 'g'), '\\bLTD\\.?$', 'LIMITED', 'g')"


def gstin(k: str) -> str:
    return f"(lpad(CAST({k} % 37 + 1 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST({k} AS VARCHAR), 4, '0') || 'F1Z' || CAST({k} % 10 AS VARCHAR))"


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _says(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


def _ladder(op: str, ladder: bool) -> str:
    choice = lambda part: f"CASE WHEN a_{part} {op} e_{part} THEN 'PASS' ELSE 'FAIL' END"
    named = f"(coalesce({_says('a', 'year', 'month', 'day')}, false) OR coalesce({_says('e', 'year', 'month')}, false))"
    first = f"WHEN a_months IS NOT NULL AND e_months IS NOT NULL AND {named} THEN {choice('months')}" if ladder else ""
    last = f"WHEN a_day IS NOT NULL AND e_day IS NOT NULL THEN {choice('day')}" if ladder else ""
    return f"CASE {first} WHEN a_num IS NOT NULL AND e_num IS NOT NULL THEN {choice('num')} {last} ELSE 'REVIEW' END"


_EQ = f"""CASE WHEN a_flag IS NOT NULL AND e_flag IS NOT NULL AND (coalesce(lower(a) IN ('yes','no','true','false','y','n'), false) OR coalesce(lower(e) IN ('yes','no','true','false','y','n'), false)) THEN CASE WHEN a_flag = e_flag THEN 'PASS' ELSE 'FAIL' END
WHEN a_months IS NOT NULL AND e_months IS NOT NULL AND (coalesce({_says('a', 'year', 'month', 'day')}, false) OR coalesce({_says('e', 'year', 'month', 'day')}, false)) THEN CASE WHEN a_months = e_months THEN 'PASS' ELSE 'FAIL' END
WHEN a_num IS NOT NULL AND e_num IS NOT NULL THEN CASE WHEN a_num = e_num THEN 'PASS' ELSE 'FAIL' END
WHEN coalesce(a_cat = e_cat, false) THEN 'PASS' ELSE 'FAIL' END"""
_IN = f"CASE WHEN coalesce(list_contains(list_transform(string_split(e, ','), lambda x: {categorical('x')}), a_cat), false) THEN 'PASS' ELSE 'FAIL' END"
_NOT = "CASE WHEN NOT a_present THEN 'MISSING' WHEN ({0}) = 'PASS' THEN 'FAIL' WHEN ({0}) = 'FAIL' THEN 'PASS' ELSE ({0}) END"
_LOW, _HIGH = (f"trim((CASE WHEN regexp_matches(e, '\\s+to\\s+') THEN regexp_split_to_array(e, '\\s+to\\s+') ELSE string_split(e, '-') END)[{k}])" for k in (1, 2))
_BETWEEN = f"CASE WHEN a_num IS NOT NULL AND {amount('lo')} IS NOT NULL AND {amount('hi')} IS NOT NULL THEN CASE WHEN a_num BETWEEN {amount('lo')} AND {amount('hi')} THEN 'PASS' ELSE 'FAIL' END WHEN a_day IS NOT NULL AND {date('lo')} IS NOT NULL AND {date('hi')} IS NOT NULL THEN CASE WHEN a_day BETWEEN {date('lo')} AND {date('hi')} THEN 'PASS' ELSE 'FAIL' END ELSE 'REVIEW' END"
_part = lambda key: f"(CASE WHEN a LIKE '{{%' THEN json_extract_string(a, '$.{key}') END)"
_STATUS = f"""CASE WHEN a IS NULL OR trim(a) = '' THEN 'MISSING'
WHEN op = '>=' THEN {_ladder('>=', True)} WHEN op = '<=' THEN {_ladder('<=', True)} WHEN op = '>' THEN {_ladder('>', False)} WHEN op = '<' THEN {_ladder('<', False)}
WHEN op = '==' THEN {_EQ} WHEN op = '!=' THEN {_NOT.format(_EQ)} WHEN op = 'IN' THEN {_IN} WHEN op = 'NOT_IN' THEN {_NOT.format(_IN)}
WHEN op = 'CONTAINS' THEN CASE WHEN coalesce(contains(lower(a), lower(e)), false) THEN 'PASS' ELSE 'FAIL' END
WHEN op = 'MATCHES' THEN CASE WHEN e IS NULL THEN 'FAIL' WHEN try(regexp_matches(a, '(?i)' || e)) IS NULL THEN 'REVIEW' WHEN try(regexp_matches(a, '(?i)' || e)) THEN 'PASS' ELSE 'FAIL' END
WHEN op = 'EXISTS' THEN CASE WHEN a_present THEN 'PASS' ELSE 'MISSING' END
WHEN op = 'VALID_ON' THEN CASE WHEN a LIKE '{{%' THEN CASE WHEN {_part('valid')} = 'false' OR {_part('is_valid')} = 'false' THEN 'FAIL' WHEN {date(_part('expiry_date'))} IS NULL THEN 'REVIEW' WHEN DATE '{REFERENCE_DATE}' <= {date(_part('expiry_date'))} AND ({date(_part('issue_date'))} IS NULL OR {date(_part('issue_date'))} <= DATE '{REFERENCE_DATE}') THEN 'PASS' ELSE 'FAIL' END WHEN a_day IS NULL THEN 'REVIEW' WHEN DATE '{REFERENCE_DATE}' <= a_day THEN 'PASS' ELSE 'FAIL' END
WHEN op = 'BEFORE' THEN CASE WHEN a_day IS NULL OR e_day IS NULL THEN 'REVIEW' WHEN a_day < e_day THEN 'PASS' ELSE 'FAIL' END
WHEN op = 'AFTER' THEN CASE WHEN a_day IS NULL OR e_day IS NULL THEN 'REVIEW' WHEN a_day > e_day THEN 'PASS' ELSE 'FAIL' END
WHEN op = 'BETWEEN' THEN {_BETWEEN} ELSE 'REVIEW' END"""


def readings(source: str) -> str:
    """All readings of ``a`` and ``e`` of a relation with columns a, e and op, and the status of op on them."""
    parts = ", ".join(f"{f(s)} AS {s}_{n}" for s in "ae" for n, f in (("num", amount), ("months", duration), ("day", date), ("flag", boolean), ("cat", categorical), ("present", exists)))
    return f"SELECT *, {_STATUS} AS op_status FROM (SELECT *, {parts}, {_LOW} AS lo, {_HIGH} AS hi FROM {source})"


def compare(field: str, a: str, b: str) -> str:
    same = f"upper(trim(coalesce({a}, ''))) = upper(trim(coalesce({b}, '')))"
    one = lambda s, t, v: f"struct_pack(status := '{s}', finding_type := '{t}', severity := '{v}')"
    pair = lambda cond, good, bad, v="HIGH": f"CASE WHEN {cond} THEN {one('CONSISTENT', good, 'INFO')} ELSE {one('CONTRADICTION', bad, v)} END"
    has = lambda *w: "(" + " OR ".join(f"contains(lower({field}), '{x}')" for x in w) + ")"
    la, lb = legal_name(a), legal_name(b)
    return f"""CASE WHEN {has('gstin', 'gst')} THEN {pair(same, 'CONSISTENT_GSTIN', 'GSTIN_CONTRADICTION')}
WHEN lower({field}) = 'pan' OR {has('_pan', 'pan_', 'pan_number')} THEN {pair(same, 'CONSISTENT_PAN', 'PAN_CONTRADICTION')}
WHEN {has('udyam', 'msme')} THEN {pair(same, 'CONSISTENT_UDYAM', 'UDYAM_CONTRADICTION')}
WHEN {has('warranty', 'experience', 'duration')} AND {duration(a)} IS NOT NULL AND {duration(b)} IS NOT NULL THEN {pair(f'{duration(a)} = {duration(b)}', 'CONSISTENT_DURATION', 'WARRANTY_CONTRADICTION')}
WHEN {has('turnover', 'revenue', 'financial', 'amount', 'price')} AND {amount(a)} IS NOT NULL AND {amount(b)} IS NOT NULL THEN {pair(f'{amount(a)} = {amount(b)}', 'CONSISTENT_TURNOVER', 'TURNOVER_CONTRADICTION')}
WHEN {has('company', 'bidder', 'legal_name', 'entity_name')} THEN CASE WHEN {la} = {lb} AND trim({a}) <> trim({b}) THEN {one('CONSISTENT', 'BENIGN_NAME_VARIANT', 'INFO')} WHEN {la} = {lb} THEN {one('CONSISTENT', 'CONSISTENT_COMPANY_NAME', 'INFO')} WHEN contains({la}, {lb}) OR contains({lb}, {la}) THEN {one('REVIEW', 'COMPANY_NAME_VARIANT', 'MEDIUM')} ELSE {one('CONTRADICTION', 'COMPANY_NAME_CONTRADICTION', 'HIGH')} END
ELSE {pair(same, 'CONSISTENT_MATCH', 'GENERAL_CONTRADICTION', 'MEDIUM')} END"""


CLEAN = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
UNPRINTABLE = "len(regexp_extract_all(c, '[\\x00-\\x08\\x0E-\\x1F\\x7F]'))"
#: The longest run of one character of each ``text`` of a relation with a ``block_id`` of its own.
RUN_SIZES = "SELECT block_id, max(c) AS c FROM (SELECT block_id, ch, g, count(*) AS c FROM (SELECT block_id, ch, i - row_number() OVER (PARTITION BY block_id, ch ORDER BY i) AS g FROM (SELECT block_id, unnest(string_split(text, '')) AS ch, unnest(range(1, len(string_split(text, '')) + 1)) AS i FROM {0} WHERE text <> '')) GROUP BY block_id, ch, g) GROUP BY block_id"


def validated(source: str) -> str:
    """A relation with columns block_id, text and sure_of, with the composite score and validity of its texts."""
    hits = " + ".join(f"CAST(regexp_matches(c, '(?i){p}') AS INT)" for p in TOKEN_PATTERNS)
    return f"""SELECT * EXCLUDE (composite, letters, printable, run, tokens, whole, n_clean, c, r), round(composite, 6) AS composite, CASE WHEN n_clean = 0 OR n_clean < 10 OR printable < 0.70 OR letters < 0.20 OR run > 0.50 OR composite < 0.25 THEN 'FAILED' WHEN n_clean < 30 OR letters < 0.40 OR sure_of < 0.50 OR composite < 0.50 THEN 'LOW_CONFIDENCE' ELSE 'ACCEPTED' END AS validity FROM (
SELECT *, CASE WHEN n_clean = 0 THEN 0.0::DOUBLE WHEN run > 0.35 THEN whole * 0.5::DOUBLE ELSE whole END AS composite FROM (
SELECT *, (0.35::DOUBLE * sure_of + 0.25::DOUBLE * letters + 0.25::DOUBLE * tokens + 0.15::DOUBLE * least(1.0::DOUBLE, n_clean / 150.0::DOUBLE)) * printable AS whole FROM (
SELECT *, length(c) AS n_clean, 1 - {UNPRINTABLE}::DOUBLE / nullif(length(c), 0) AS printable, len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]'))::DOUBLE / nullif(length(c), 0) AS letters, round(coalesce(r, 0)::DOUBLE / greatest(1, length(c)), 6) AS run, CASE WHEN length(c) < 10 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ({hits}) / 3.0::DOUBLE) END AS tokens
FROM (SELECT b.*, {CLEAN} AS c, r FROM {source} b LEFT JOIN (SELECT block_id, c AS r FROM ({RUN_SIZES.format(f"(SELECT block_id, {CLEAN} AS text FROM {source})")})) z ON z.block_id = b.block_id))))"""


def clone(suffix: str, *names: str) -> None:
    """Copies of views, named with ``suffix``, that read each other's copies in place of the originals."""
    renamed = re.compile(r"\b(FROM|JOIN) (" + "|".join(names) + r")\b")
    for name in names:
        if name + suffix not in _VIEWS:
            body, needs = _VIEWS[name]
            _VIEWS[name + suffix] = renamed.sub(lambda m: f"{m[1]} {m[2]}{suffix}", body), tuple(x + suffix if x in names else x for x in needs)


_ROWS = ", ".join("(" + ", ".join(_value(v) for v in r) + ")" for r in requirement_rows())
_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    _VIEWS[name] = (sql, needs)


def sql(select: str, *needs: str) -> str:
    """``select`` after the views that it needs, each once and in order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for other in _VIEWS[name][1]:
                add(other)
            done.append(name)

    for name in needs:
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_VIEWS[n][0]})" for n in done) + "\n" if done else "") + select


ALIAS_VALUES = ", ".join(f"('{a}', '{c}')" for c, some in ALIASES.items() for a in dict.fromkeys((*some, c.lower())))
AMBIGUOUS_LIST = _list(AMBIGUOUS)

_REQ_COLUMNS = "requirement_id, tender_id, category, field, operator, expected_value, mandatory, source_type, source_priority, mse_exemption_allowed, require_explicit_claim, app_status, startup_exemption_allowed, tender_category, applicable_categories, applicable_roles, mandate_for_all_sizes"
view("reqs", f"SELECT * FROM (VALUES {_ROWS}) t({_REQ_COLUMNS})")
view("bids", "SELECT o_orderkey AS bid_id, o_orderpriority AS tender_id, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'UNCERTAIN' END AS truth FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
view("lines", "SELECT *, l_orderkey AS bid_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_no FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")


def pan(k: str) -> str:
    return f"substring({gstin(k)}, 3, 10)"


def udyam(k: str) -> str:
    return f"('UDYAM-MH-12-' || lpad(CAST({k} AS VARCHAR), 7, '0'))"


def epfo(k: str) -> str:
    return f"('MHBAN' || lpad(CAST({k} AS VARCHAR), 7, '0'))"


def esic(k: str) -> str:
    return f"('31' || lpad(CAST({k} AS VARCHAR), 8, '0'))"


_DAY = "strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d')"
_FACT = {
    "turnover_cr": "CASE WHEN line_no % 2 = 1 THEN CAST(CAST(l_quantity AS INT) % 5 + 1 AS VARCHAR) || ' crore' ELSE CAST((CAST(l_quantity AS INT) % 5 + 1) * 100 AS VARCHAR) || ' lakh' END",
    "warranty_years": "CASE WHEN line_no % 2 = 1 THEN CAST(l_partkey % 5 + 1 AS VARCHAR) || ' years' ELSE CAST((l_partkey % 5 + 1) * 12 AS VARCHAR) || ' months' END",
    "delivery_days": "CAST((l_partkey + l_suppkey) % 60 + 15 AS VARCHAR) || ' days'",
    "valid_until": f"""CASE WHEN l_partkey % 5 = 0 THEN '{{"issue_date":"' || strftime(CAST(l_shipdate AS DATE) - 200, '%Y-%m-%d') || '","expiry_date":"' || {_DAY} || '","valid":' || CASE WHEN l_partkey % 15 = 0 THEN 'false' ELSE 'true' END || '}}' WHEN line_no % 2 = 1 THEN {_DAY} ELSE strftime(CAST(l_shipdate AS DATE), '%d-%m-%Y') END""",
    "iso_cert": "CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No' ELSE 'Not available' END",
    "is_mse": "CASE l_linestatus WHEN 'O' THEN 'Y' ELSE 'N' END",
    "gstin": gstin("l_suppkey"),
    "company_name": "s_name || CASE line_no % 3 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Pvt. Ltd.' ELSE '' END",
    "pan": f"CASE line_no WHEN 1 THEN {pan('l_suppkey')} WHEN 2 THEN 'ZZZZZ' || substring({pan('l_suppkey')}, 6, 5) END",
    "employee_count": "CASE WHEN line_no = 1 THEN CASE WHEN l_partkey % 23 = 0 THEN 'about 30' ELSE CAST(CAST(l_quantity AS INT) % 40 AS VARCHAR) END END",
    "bidder_role": "CASE WHEN line_no = 1 THEN CASE l_partkey % 4 WHEN 0 THEN 'OEM' WHEN 1 THEN 'reseller' WHEN 2 THEN 'Trader' ELSE '' END END",
    "is_startup": "CASE WHEN line_no = 1 THEN CASE l_suppkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END END",
    "dpiit_number": "CASE WHEN line_no = 1 AND l_suppkey % 6 = 0 THEN 'DIPP' || CAST(l_suppkey AS VARCHAR) END",
    "udyam_registration": f"CASE WHEN line_no = 1 AND l_suppkey % 4 <> 0 THEN {udyam('l_suppkey')} END",
    "msme_number": f"CASE WHEN line_no = 1 AND l_suppkey % 12 = 0 THEN {udyam('l_suppkey')} END",
    "epfo_code": f"CASE WHEN line_no = 1 AND l_suppkey % 5 <> 0 THEN {epfo('l_suppkey')} END",
    "esic_code": f"CASE WHEN line_no = 1 AND l_suppkey % 7 <> 0 THEN {esic('l_suppkey')} END",
    "annual_turnover": "CASE WHEN line_no = 2 AND l_partkey % 9 = 0 THEN CAST(CAST(l_quantity AS INT) % 5 + 2 AS VARCHAR) || ' crore' END",
}
view("facts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT bid_id, '{k}' AS field, {v} AS value, 'D' || CAST(l_linenumber AS VARCHAR) AS source_document, line_no AS page, CASE WHEN l_tax > 0.07 THEN 'LOW' ELSE 'HIGH' END AS extraction_confidence, line_no AS fact_seq FROM lines" for k, v in _FACT.items()) + ") WHERE value IS NOT NULL", "lines")
_OTHER = "CASE WHEN s_suppkey % 13 = 0 THEN 'Other ' || CAST(s_suppkey AS VARCHAR) ELSE s_name END"
_S = "CAST(s_suppkey AS VARCHAR)"
_RECORDS = (  # registry, key, left out, not active, facts of a verified record
    ("GST", gstin("s_suppkey"), "s_suppkey % 17 = 0", ("s_acctbal < 0", "CANCELLED"), {"gstin": gstin("s_suppkey"), "legal_name": "s_name", "gst_status": "'ACTIVE'", "taxpayer_type": "CASE WHEN s_suppkey % 2 = 0 THEN 'Regular' ELSE 'Composition' END", "registration_date": "CASE WHEN s_suppkey % 3 <> 0 THEN '2017-07-01' END", "pan": pan("s_suppkey"), "gst_filing_compliance": "'TOTAL_FILED_' || CAST(s_suppkey % 12 AS VARCHAR)"}),
    ("PAN", pan("s_suppkey"), "s_suppkey % 23 = 0", ("s_suppkey % 19 = 0", "INACTIVE"), {"pan": pan("s_suppkey")}),
    ("UDYAM", udyam("s_suppkey"), "s_suppkey % 7 = 0", ("s_suppkey % 11 = 0", "SUSPENDED"), {"udyam_registration": udyam("s_suppkey"), "is_mse": "'true'"}),
    ("ITD", pan("s_suppkey"), "s_suppkey % 10 = 0", ("s_suppkey % 5 = 0", "NOT_FILED"), {"itr_filing_status": "'FILED'", "itr_ack_number": f"'ACK' || {_S}", "turnover_cr": "CAST(s_suppkey % 9 + 1 AS VARCHAR)"}),
    ("MCA21", "s_name", "s_suppkey % 9 = 0", ("s_suppkey % 8 = 0", "STRUCK_OFF"), {"cin": f"'U' || lpad({_S}, 5, '0') || 'MH'", "legal_name": _OTHER, "mca_status": "'ACTIVE'"}),
    ("NSIC", "s_name", "s_suppkey % 4 = 0", ("s_suppkey % 6 = 0", "EXPIRED"), {"nsic_registration": f"'NSIC' || {_S}", "is_mse": "'true'"}),
    ("OEM", "'ACME:' || s_name", "s_suppkey % 5 = 0", ("s_suppkey % 12 = 0", "EXPIRED"), {"oem_authorization": f"'MAF' || {_S}", "oem_authorized": "'true'"}),
    ("EPFO", epfo("s_suppkey"), "s_suppkey % 21 = 0", ("s_suppkey % 16 = 0", "INACTIVE"), {"epfo_establishment": epfo("s_suppkey")}),
    ("ESIC", esic("s_suppkey"), "s_suppkey % 18 = 0", ("s_suppkey % 22 = 0", "INACTIVE"), {"esic_employer": esic("s_suppkey")}),
    ("DPIIT", f"'DIPP' || {_S}", "s_suppkey % 12 = 0", ("s_suppkey % 18 = 0", "EXPIRED"), {"dpiit_recognition_number": f"'DIPP' || {_S}", "is_startup": "'true'"}),
    ("MII", "s_name || ':GOODS'", "s_suppkey % 3 = 0", ("s_suppkey % 14 = 0", "INVALID"), {"local_content_percent": "CAST(s_suppkey % 60 + 20 AS VARCHAR)", "mii_declaration": f"'MII' || {_S}"}),
)
view("registry", " UNION ALL ".join(f"SELECT '{r}' AS registry, {k} AS key, {_OTHER} AS holder, CASE WHEN {bad} THEN '{word}' ELSE 'ACTIVE' END AS state, [{', '.join(f"struct_pack(field := '{f}', value := {v})" for f, v in told.items())}] AS details FROM supplier WHERE NOT ({out})" for r, k, out, (bad, word), told in _RECORDS))
view("debarred", f"SELECT CASE WHEN s_suppkey % 2 = 0 THEN {pan('s_suppkey')} END AS pan, CASE WHEN s_suppkey % 3 = 0 THEN {gstin('s_suppkey')} END AS gstin, CASE WHEN s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 THEN s_name END AS entity_name FROM supplier WHERE s_suppkey % 29 = 0")
view("blocks", "SELECT doc_id, lang, CAST((position // 10) + 1 AS INT) AS page_number, position, CAST(doc_id AS VARCHAR) || '-p' || CAST((position // 10) + 1 AS VARCHAR) || '-b' || CAST(position AS VARCHAR) AS block_id, text FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS position FROM documents)")
view("statements", f"SELECT bid_id AS doc_id, line_no AS page_number, 's' || CAST(line_no AS VARCHAR) AS block_id, 'Warranty period: ' || CAST(l_partkey % 5 + 1 AS VARCHAR) || ' years. Turnover: Rs. ' || CAST(CAST(l_quantity AS INT) % 5 + 1 AS VARCHAR) || ' crore. Delivery: ' || CAST(l_partkey % 60 + 15 AS VARCHAR) || ' days. GSTIN ' || {gstin('l_suppkey')} || ', PAN ' || {pan('l_suppkey')} || CASE WHEN l_partkey % 3 = 0 THEN '. ISO 9001:2015 certified' ELSE '. Not certified' END || CASE WHEN l_partkey % 4 = 0 THEN '; local support available.' ELSE '.' END AS text, l_partkey, l_suppkey, l_quantity, s_name FROM lines", "lines")
view("canon", f"SELECT field, c AS canonical FROM (SELECT DISTINCT field FROM facts UNION SELECT DISTINCT field FROM reqs) n LEFT JOIN (VALUES {ALIAS_VALUES}) t(a, c) ON a = {field_key('field')} AND {field_key('field')} NOT IN {AMBIGUOUS_LIST}", "facts", "reqs")
view("prec", "SELECT *, row_number() OVER w AS rank, first_value(requirement_id) OVER w AS winner, list(requirement_id) OVER (PARTITION BY tender_id, field ORDER BY source_priority DESC, requirement_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS chain FROM (SELECT * REPLACE (CASE WHEN source_priority = 0 THEN CASE source_type WHEN 'GTC' THEN 1 WHEN 'STC' THEN 2 WHEN 'ATC' THEN 3 ELSE 0 END ELSE source_priority END AS source_priority) FROM reqs) WINDOW w AS (PARTITION BY tender_id, field ORDER BY source_priority DESC, requirement_id DESC)", "reqs")
view("first_facts", "SELECT bid_id, f.field, c.canonical, value, source_document, page, extraction_confidence, fact_seq FROM (SELECT *, row_number() OVER (PARTITION BY bid_id, field ORDER BY fact_seq) AS r FROM facts) f JOIN canon c ON f.field = c.field WHERE r = 1", "facts", "canon")
view("last_facts", "SELECT bid_id, field, max_by(value, fact_seq) AS value FROM facts GROUP BY ALL", "facts")
view("first_canonical", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bid_id, canonical ORDER BY fact_seq, field) AS r FROM first_facts WHERE canonical IS NOT NULL) WHERE r = 1", "first_facts")
view("profile", "SELECT f.bid_id, " + ", ".join(f"max(CASE WHEN f.field = '{x}' THEN f.value END) AS {x}_first, max(CASE WHEN f.field = '{x}' THEN l.value END) AS {x}_last, max(CASE WHEN f.field = '{x}' THEN f.extraction_confidence END) AS {x}_confidence" for x in PROFILE) + " FROM first_facts f JOIN last_facts l ON f.bid_id = l.bid_id AND f.field = l.field GROUP BY f.bid_id", "first_facts", "last_facts")
_ROLE = "upper(trim(coalesce(bidder_role_last, '')))"
_PEOPLE = "trim(employee_count_last)"
_SMALL = lambda n: f"(regexp_matches({_PEOPLE}, '^[+-]?[0-9]+$') AND TRY_CAST({_PEOPLE} AS INT) < {n} AND NOT mandate_for_all_sizes)"
_OEM, _EPFO, _ESIC = "(category = 'OEM_AUTHORIZATION' OR contains(field, 'oem_auth'))", "(contains(field, 'epfo') OR category = 'EPFO_COMPLIANCE')", "(contains(field, 'esic') OR category = 'ESIC_COMPLIANCE')"
_SPARED = "(regexp_matches(field, 'turnover|experience|past_performance') OR regexp_matches(lower(category), 'turnover|experience|past_performance'))"
_MSE, _STARTUP = (f"({_SPARED} AND {x}_exemption_allowed AND coalesce({boolean(f'is_{x}_last')}, false))" for x in ("mse", "startup"))
_RULES = (
    ("rank > 1", "NOT_APPLICABLE", "PRECEDENCE_SUPERSEDED"),
    ("app_status = 'NOT_APPLICABLE'", "NOT_APPLICABLE", "EXPLICIT_SPECIFICATION"),
    ("app_status IN ('UNKNOWN', 'UNKNOWN_REVIEW', 'REVIEW')", "UNKNOWN_REVIEW", "TENDER_SPECIFICATION_UNCERTAIN"),
    ("applicable_categories IS NOT NULL AND tender_category <> '' AND NOT list_contains(string_split(applicable_categories, ','), tender_category)", "NOT_APPLICABLE", "CATEGORY_EXCLUSION"),
    (f"{_OEM} AND bidder_role_confidence = 'LOW'", "UNKNOWN_REVIEW", "OEM_STATUS_UNCERTAIN"),
    (f"{_OEM} AND {_ROLE} IN {_list(SELF_MADE)}", "NOT_APPLICABLE", "OEM_SELF_MANUFACTURER"),
    (f"applicable_roles IS NOT NULL AND {_ROLE} = ''", "UNKNOWN_REVIEW", "BIDDER_ROLE_UNVERIFIED"),
    (f"applicable_roles IS NOT NULL AND NOT list_contains(string_split(applicable_roles, ','), {_ROLE})", "NOT_APPLICABLE", "BIDDER_ROLE_EXCLUSION"),
    (f"({_EPFO} OR {_ESIC}) AND NOT regexp_matches({_PEOPLE}, '^[+-]?[0-9]+$')", "UNKNOWN_REVIEW", "STATUTORY_THRESHOLD_UNVERIFIED"),
    (f"(({_EPFO} AND {_SMALL(20)}) OR ({_ESIC} AND {_SMALL(10)})) AND employee_count_confidence = 'LOW'", "UNKNOWN_REVIEW", "STATUTORY_THRESHOLD_UNVERIFIED"),
    (f"{_EPFO} AND {_SMALL(20)}", "NOT_APPLICABLE", "STATUTORY_THRESHOLD_EPFO"),
    (f"{_ESIC} AND {_SMALL(10)}", "NOT_APPLICABLE", "STATUTORY_THRESHOLD_ESIC"),
    (f"{_MSE} AND coalesce(is_mse_confidence, udyam_registration_confidence) = 'LOW'", "UNKNOWN_REVIEW", "EXEMPTION_EVIDENCE_AMBIGUOUS"),
    (_MSE, "NOT_APPLICABLE", "MSE_STATUTORY_EXEMPTION"),
    (f"{_STARTUP} AND coalesce(is_startup_confidence, dpiit_recognized_confidence) = 'LOW'", "UNKNOWN_REVIEW", "EXEMPTION_EVIDENCE_AMBIGUOUS"),
    (_STARTUP, "NOT_APPLICABLE", "STARTUP_STATUTORY_EXEMPTION"),
)
_case = lambda k, other: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[k]}'" for r in _RULES) + f" ELSE '{other}' END"
view("asked", f"SELECT *, {_case(1, 'APPLICABLE')} AS applicability, {_case(2, 'STANDARD_APPLICABLE')} AS applicability_rule FROM (SELECT b.bid_id, p.*, c.canonical, m.* EXCLUDE (bid_id) FROM bids b JOIN prec p ON b.tender_id = p.tender_id LEFT JOIN canon c ON p.field = c.field LEFT JOIN profile m ON b.bid_id = m.bid_id)", "bids", "prec", "canon", "profile")
_IS_MSE, _IS_STARTUP = ("coalesce(" + ", ".join(boolean(f"{x}_first") for x in some) + ")" for some in (("is_mse", "mse_registered", "udyam_registration"), ("is_startup", "startup_recognized", "dpiit_recognized")))
_CERTIFIED = "(dpiit_number_first IS NOT NULL OR dpiit_certificate_first IS NOT NULL)"
view(
    "joined",
    f"""SELECT q.*, coalesce(f.value, g.value) AS a, q.expected_value AS e, trim(q.operator) AS op, coalesce(f.source_document, g.source_document) AS source_document, CASE WHEN f.value IS NOT NULL THEN f.page ELSE g.page END AS page, CASE WHEN f.value IS NOT NULL THEN f.extraction_confidence ELSE g.extraction_confidence END AS extraction_confidence,
CASE WHEN rank > 1 THEN 'SUPERSEDED' WHEN mse_exemption_allowed AND coalesce({_IS_MSE}, false) THEN 'EXEMPT' WHEN mse_exemption_allowed AND {_IS_MSE} IS NULL AND require_explicit_claim THEN 'UNCLAIMED' WHEN startup_exemption_allowed AND coalesce({_IS_STARTUP}, false) AND {_CERTIFIED} THEN 'EXEMPT' WHEN startup_exemption_allowed AND (coalesce({_IS_STARTUP}, false) OR ({_IS_STARTUP} IS NULL AND require_explicit_claim)) THEN 'UNCLAIMED' WHEN f.value IS NULL AND g.value IS NULL THEN 'ABSENT' ELSE 'EVALUATED' END AS basis
FROM asked q LEFT JOIN first_facts f ON q.bid_id = f.bid_id AND q.field = f.field LEFT JOIN first_canonical g ON q.bid_id = g.bid_id AND q.canonical = g.canonical""",
    "asked", "first_facts", "first_canonical",
)
view("decided", "SELECT DISTINCT a, e, op, op_status FROM (" + readings("(SELECT DISTINCT a, e, op FROM joined)") + ")", "joined")
view(
    "results",
    """SELECT bid_id, tender_id, requirement_id, category, field, canonical, operator, mandatory, applicability, applicability_rule, basis, winner, rank, a AS actual, expected_value, source_document, page,
CASE WHEN basis IN ('SUPERSEDED', 'EXEMPT') THEN 'N/A' WHEN basis = 'UNCLAIMED' THEN 'REVIEW' WHEN basis = 'ABSENT' THEN 'MISSING' ELSE op_status END AS status,
CASE WHEN basis IN ('SUPERSEDED', 'EXEMPT') THEN 'INFO' WHEN basis = 'UNCLAIMED' THEN 'MAJOR' WHEN basis = 'ABSENT' THEN CASE WHEN mandatory THEN 'CRITICAL' ELSE 'MINOR' END WHEN op_status = 'PASS' THEN 'INFO' WHEN op_status = 'FAIL' AND mandatory THEN 'CRITICAL' WHEN op_status IN ('FAIL', 'REVIEW') THEN 'MAJOR' ELSE 'MINOR' END AS severity,
CASE WHEN basis IN ('SUPERSEDED', 'EXEMPT') THEN false WHEN basis = 'UNCLAIMED' THEN true WHEN basis = 'ABSENT' THEN mandatory ELSE op_status = 'REVIEW' OR (op_status = 'MISSING' AND op <> 'EXISTS') OR extraction_confidence = 'LOW' END AS requires_review
FROM (SELECT j.*, d.op_status FROM joined j JOIN decided d ON j.a IS NOT DISTINCT FROM d.a AND j.e IS NOT DISTINCT FROM d.e AND j.op = d.op)""",
    "joined", "decided",
)
view("grouped", f"SELECT f.bid_id, f.field AS raw, CASE WHEN canonical IS NOT NULL AND canonical NOT IN {_list(NOT_COMPARED)} THEN canonical ELSE f.field END AS field, value, source_document, page, fact_seq FROM facts f JOIN canon c ON f.field = c.field", "facts", "canon")
view("raw_pairs", "SELECT a.bid_id, a.field, a.raw AS raw_field_a, b.raw AS raw_field_b, a.fact_seq AS seq_a, b.fact_seq AS seq_b, a.value AS value_a, b.value AS value_b, a.source_document AS document_a, b.source_document AS document_b, a.page AS page_a, b.page AS page_b FROM grouped a JOIN grouped b ON a.bid_id = b.bid_id AND a.field = b.field AND (a.fact_seq < b.fact_seq OR (a.fact_seq = b.fact_seq AND a.raw < b.raw)) AND (a.source_document <> b.source_document OR a.page <> b.page)", "grouped")
view("compared", f"SELECT field, value_a, value_b, {compare('field', 'value_a', 'value_b')} AS x FROM (SELECT DISTINCT field, value_a, value_b FROM raw_pairs)", "raw_pairs")
view("pairs", "SELECT p.*, x.status AS status, x.finding_type AS finding_type, x.severity AS severity FROM raw_pairs p JOIN compared c ON p.field = c.field AND p.value_a = c.value_a AND p.value_b = c.value_b", "raw_pairs", "compared")
FINDING_ID = "format('{}-{}-{:06d}-{}-{:06d}', field, raw_field_a, seq_a, raw_field_b, seq_b)"
view("findings", f"SELECT *, {FINDING_ID} AS finding_id FROM pairs WHERE status <> 'CONSISTENT'", "pairs")
_BY_CANONICAL = {"gstin": ("gstin", "GSTIN"), "pan": ("pan", "PAN"), "udyam": ("udyam_registration", "UDYAM_REGISTRATION"), "expected_name": ("company_name", "LEGAL_ENTITY_NAME")}
view(
    "ids",
    "SELECT bid_id, " + ", ".join(f"coalesce(max(value) FILTER (field = '{f}'), max(other) FILTER (canonical = '{c}')) AS {n}" for n, (f, c) in _BY_CANONICAL.items())
    + ", max(value) FILTER (field = 'epfo_code') AS epfo, max(value) FILTER (field = 'esic_code') AS esic, max(value) FILTER (field = 'dpiit_number') AS dpiit FROM (SELECT bid_id, field, value, NULL AS canonical, NULL AS other FROM last_facts UNION ALL SELECT bid_id, NULL, NULL, canonical, max_by(value, struct_pack(s := fact_seq, f := field)) FROM facts JOIN canon USING (field) WHERE canonical IS NOT NULL GROUP BY bid_id, canonical) GROUP BY bid_id",
    "last_facts", "facts", "canon",
)
view("questions", "SELECT bid_id, expected_name, unnest(['GST', 'PAN', 'UDYAM', 'ITD', 'MCA21', 'NSIC', 'OEM', 'MII', 'EPFO', 'ESIC', 'DPIIT']) AS registry, unnest([gstin, pan, udyam, CASE WHEN pan IS NOT NULL THEN pan WHEN length(trim(gstin)) = 15 THEN substring(upper(trim(gstin)), 3, 10) END, expected_name, expected_name, NULL, NULL, epfo, esic, dpiit]) AS identifier, unnest([NULL, NULL, expected_name, NULL, NULL, NULL, 'ACME:' || expected_name, expected_name || ':GOODS', NULL, NULL, NULL]) AS other FROM ids", "ids")
view("records", "SELECT registry, upper(regexp_replace(key, '\\s', '', 'g')) AS k, min_by(struct_pack(holder := holder, state := state, details := details), struct_pack(h := holder, s := state)) AS r FROM registry GROUP BY ALL", "registry")
_A, _B = registry_name("x.holder"), registry_name("expected_name")
view("checks", f"SELECT bid_id, registry, identifier, expected_name, x.holder AS holder, x.details AS details, CASE WHEN x IS NULL THEN 'NOT_FOUND' WHEN x.state <> 'ACTIVE' THEN CASE WHEN registry IN ('UDYAM', 'ITD') THEN 'REVIEW' ELSE 'INACTIVE' END WHEN expected_name IS NOT NULL AND NOT ({_A} = {_B} OR contains({_A}, {_B}) OR contains({_B}, {_A})) THEN 'IDENTITY_MISMATCH' ELSE 'VERIFIED' END AS status FROM (SELECT q.*, coalesce(a.r, b.r) AS x FROM questions q LEFT JOIN records a ON a.registry = q.registry AND a.k = upper(regexp_replace(q.identifier, '\\s', '', 'g')) LEFT JOIN records b ON b.registry = q.registry AND b.k = upper(regexp_replace(q.other, '\\s', '', 'g')) WHERE q.identifier IS NOT NULL OR q.other IS NOT NULL)", "questions", "records")
view("debarment", "SELECT bid_id, coalesce(pan IN (SELECT d.pan FROM debarred d WHERE d.pan IS NOT NULL), false) OR coalesce(gstin IN (SELECT d.gstin FROM debarred d WHERE d.gstin IS NOT NULL), false) OR coalesce(upper(replace(expected_name, ' ', '')) IN (SELECT upper(replace(entity_name, ' ', '')) FROM debarred WHERE entity_name IS NOT NULL), false) AS debarred FROM ids", "ids", "debarred")
view("warnings", "SELECT bid_id, field || '-' || CAST(page AS VARCHAR) AS related FROM first_facts WHERE extraction_confidence = 'LOW' AND field IN ('gstin', 'turnover_cr')", "first_facts")
view("compliance", "SELECT *, CASE WHEN critical + major > 0 THEN 'FAIL' WHEN missing > 0 THEN 'MISSING' WHEN review > 0 THEN 'REVIEW' WHEN passed = total THEN 'PASS' ELSE 'PARTIAL' END AS compliance_status FROM (SELECT bid_id, count(*) FILTER (status IN ('FAIL', 'OVERRIDDEN_FAIL') AND severity = 'CRITICAL') AS critical, count(*) FILTER (status IN ('FAIL', 'OVERRIDDEN_FAIL') AND severity <> 'CRITICAL') AS major, count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status IN ('REVIEW', 'PARTIAL')) AS review, count(*) FILTER (status IN ('PASS', 'OVERRIDDEN_PASS')) AS passed, count(*) AS total FROM results GROUP BY bid_id)", "results")
view("integ", "SELECT bid_id, count(*) FILTER (status = 'CONTRADICTION') AS contradictions, count(*) FILTER (status = 'REVIEW') AS integrity_reviews, count(*) FILTER (status = 'CONTRADICTION' AND severity IN ('HIGH', 'CRITICAL')) AS high_contradictions, count(*) AS n_findings FROM findings GROUP BY bid_id", "findings")
view("queue", "SELECT bid_id, CASE WHEN status = 'MISSING' THEN 'MISSING_EVIDENCE' ELSE 'AMBIGUOUS_COMPLIANCE' END AS category, severity, requirement_id AS related, 1 AS source_order FROM results WHERE requires_review OR status IN ('REVIEW', 'PARTIAL', 'MISSING') UNION ALL SELECT bid_id, 'INTEGRITY_CONTRADICTION', CASE severity WHEN 'HIGH' THEN 'CRITICAL' ELSE 'MAJOR' END, finding_id, 2 FROM findings UNION ALL SELECT bid_id, 'DEBARMENT_ALERT', 'CRITICAL', 'DEBARMENT', 3 FROM debarment WHERE debarred UNION ALL SELECT bid_id, 'GOVERNMENT_MISMATCH', 'MAJOR', registry, 4 FROM checks WHERE status IN ('IDENTITY_MISMATCH', 'INACTIVE', 'SUSPENDED', 'REVIEW', 'UNVERIFIED', 'UNAVAILABLE') UNION ALL SELECT bid_id, 'GROUNDING_WARNING', 'MINOR', related, 5 FROM warnings", "results", "findings", "debarment", "checks", "warnings")
view("weighted", "SELECT *, applicability <> 'NOT_APPLICABLE' AS live, applicability <> 'NOT_APPLICABLE' AND status <> 'N/A' AS applies, applicability = 'UNKNOWN_REVIEW' AND status = 'PASS' AS unsure, CASE WHEN applicability <> 'NOT_APPLICABLE' AND status <> 'N/A' THEN (CASE WHEN mandatory THEN 10.0::DOUBLE ELSE 4.0::DOUBLE END) * (CASE severity WHEN 'CRITICAL' THEN 1.5::DOUBLE WHEN 'MAJOR' THEN 1.0::DOUBLE WHEN 'MINOR' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) ELSE 0.0::DOUBLE END AS weight FROM results", "results")
view(
    "scores",
    """SELECT *, CASE WHEN debarred THEN 'DEBARMENT' WHEN contra AND first_score > 65 THEN 'CONTRADICTION' WHEN first_score < raw_score THEN CASE WHEN mandatory_fail THEN 'MANDATORY_FAIL' ELSE 'MANDATORY_MISSING' END ELSE 'NONE' END AS cap, CASE WHEN contra THEN least(first_score, 65.0::DOUBLE) ELSE first_score END AS final_score FROM (
SELECT *, CASE WHEN debarred THEN 0.0::DOUBLE WHEN mandatory_fail THEN least(raw_score, 40.0::DOUBLE) WHEN mandatory_missing THEN least(raw_score, 55.0::DOUBLE) ELSE raw_score END AS first_score, high > 0 AND NOT debarred AND NOT mandatory_fail AS contra FROM (
SELECT s.*, CASE WHEN possible > 0 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, earned / possible * 100)) ELSE 100.0::DOUBLE END AS raw_score, coalesce(d.debarred, false) AS debarred, coalesce(i.high_contradictions, 0) AS high FROM (
SELECT bid_id, count(*) AS requirements, count(*) FILTER (applies) AS applicable, count(*) FILTER (applies AND status IN ('PASS', 'OVERRIDDEN_PASS') AND NOT unsure) AS passed, count(*) FILTER (live AND status IN ('FAIL', 'OVERRIDDEN_FAIL')) AS failed, count(*) FILTER (live AND status = 'MISSING') AS missing, count(*) FILTER (live AND (unsure OR status IN ('REVIEW', 'PARTIAL'))) AS under_review, sum(weight) AS possible, sum(weight * CASE WHEN unsure THEN 0.5::DOUBLE WHEN status IN ('PASS', 'OVERRIDDEN_PASS') THEN 1.0::DOUBLE WHEN status = 'REVIEW' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) AS earned, bool_or(live AND status IN ('FAIL', 'OVERRIDDEN_FAIL') AND mandatory) AS mandatory_fail, bool_or(live AND status = 'MISSING' AND mandatory) AS mandatory_missing FROM weighted GROUP BY bid_id) s LEFT JOIN debarment d ON s.bid_id = d.bid_id LEFT JOIN integ i ON s.bid_id = i.bid_id))""",
    "weighted", "debarment", "integ",
)
view("factors", "SELECT bid_id, CASE WHEN status = 'FAIL' AND severity = 'CRITICAL' THEN 'MANDATORY_CRITICAL_FAILURE' WHEN status = 'FAIL' THEN 'MANDATORY_REQUIREMENT_FAILURE' WHEN status = 'MISSING' THEN 'MANDATORY_EVIDENCE_MISSING' ELSE 'UNRESOLVED_COMPLIANCE_REVIEW' END AS code, CASE WHEN status = 'FAIL' AND severity = 'CRITICAL' THEN 'CRITICAL' WHEN status IN ('FAIL', 'MISSING') THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM results WHERE status = 'FAIL' OR (status = 'MISSING' AND severity IN ('CRITICAL', 'MAJOR')) OR (status <> 'MISSING' AND status <> 'FAIL' AND (status IN ('REVIEW', 'PARTIAL') OR requires_review)) UNION ALL SELECT bid_id, CASE WHEN severity = 'HIGH' OR regexp_matches(finding_type, 'NAME|GSTIN|PAN') THEN 'IDENTITY_OR_CRITICAL_CONTRADICTION' ELSE 'CROSS_DOCUMENT_CONTRADICTION' END, CASE WHEN severity = 'HIGH' OR regexp_matches(finding_type, 'NAME|GSTIN|PAN') THEN 'CRITICAL' ELSE 'HIGH' END FROM findings WHERE status = 'CONTRADICTION' UNION ALL SELECT bid_id, 'GOVERNMENT_REGISTRY_MISMATCH', 'HIGH' FROM checks WHERE status IN ('IDENTITY_MISMATCH', 'INACTIVE', 'SUSPENDED') UNION ALL SELECT bid_id, 'DEBARMENT_DETECTED', 'CRITICAL' FROM debarment WHERE debarred UNION ALL SELECT bid_id, 'EVIDENCE_GROUNDING_WARNING', 'MEDIUM' FROM warnings", "results", "findings", "checks", "debarment", "warnings")
view("risk", "SELECT bid_id, CASE worst WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS level, least(1.0::DOUBLE, CASE worst WHEN 3 THEN 0.9::DOUBLE + least(0.1::DOUBLE, n * 0.02::DOUBLE) WHEN 2 THEN 0.65::DOUBLE + least(0.2::DOUBLE, n * 0.03::DOUBLE) WHEN 1 THEN 0.35::DOUBLE + least(0.25::DOUBLE, n * 0.04::DOUBLE) ELSE 0.05::DOUBLE + least(0.15::DOUBLE, n * 0.02::DOUBLE) END) AS risk_score, n AS n_factors FROM (SELECT b.bid_id, coalesce(max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 END), 0) AS worst, count(severity) AS n FROM bids b LEFT JOIN factors f ON b.bid_id = f.bid_id GROUP BY b.bid_id)", "bids", "factors")
_REGISTRY = "CASE WHEN contains(lower(field), 'pan') OR contains(lower(category), 'pan') THEN 'API_SETU_PAN_VERIFICATION' WHEN regexp_matches(lower(field), 'udyam|msme') THEN 'API_SETU_UDYAM_VERIFICATION' WHEN regexp_matches(lower(field), 'epfo|uan') THEN 'API_SETU_EPFO_VERIFICATION' WHEN regexp_matches(lower(field), 'esic|ip_number') THEN 'API_SETU_ESIC_VERIFICATION' WHEN regexp_matches(lower(field), 'dpiit|startup') THEN 'API_SETU_DPIIT_VERIFICATION' WHEN regexp_matches(lower(field), 'debarment|blacklist') THEN 'DEBARMENT_REGISTRY_CHECK' END"
view("pend", f"""SELECT *, CASE deficiency_type WHEN 'MISSING_DOCUMENT' THEN 'Submit a document that proves ' || requirement_id WHEN 'DEFICIENT_VALUE' THEN 'Submit evidence for ' || coalesce(expected_value, '') || ' instead of ' || coalesce(actual, '') WHEN 'UNVERIFIED_GOVERNMENT' THEN 'Verify with ' || registry_expected ELSE 'Officer review' END AS action FROM (
SELECT r.bid_id, requirement_id, mandatory, applicability, r.status, r.expected_value, r.actual, CASE r.status WHEN 'MISSING' THEN 'MISSING_DOCUMENT' WHEN 'FAIL' THEN 'DEFICIENT_VALUE' ELSE CASE WHEN c.status IN ('NOT_FOUND', 'UNAVAILABLE') THEN 'UNVERIFIED_GOVERNMENT' ELSE 'AMBIGUOUS_EVIDENCE' END END AS deficiency_type, registry_expected, c.registry || ': ' || c.status AS registry_result, requires_review OR r.status <> 'PASS' AS requires_review
FROM (SELECT *, {_REGISTRY} AS registry_expected FROM results WHERE applicability <> 'NOT_APPLICABLE' AND NOT (status = 'PASS' AND NOT requires_review)) r LEFT JOIN (SELECT bid_id, registry, status, 'API_SETU_' || registry || '_VERIFICATION' AS expected FROM checks UNION ALL SELECT bid_id, 'DEBARMENT', CASE WHEN debarred THEN 'DEBARRED' ELSE 'CLEAR' END, 'DEBARMENT_REGISTRY_CHECK' FROM debarment) c ON c.bid_id = r.bid_id AND c.expected = r.registry_expected)""", "results", "checks", "debarment")
view("overall", "SELECT bid_id, compliance_status, integrity_status, overall_status, overall_status = 'REVIEW' OR n_items > 0 AS review_required, CAST(anomalies AS BIGINT) AS anomalies, debarred FROM (SELECT *, CASE WHEN debarred OR compliance_status = 'FAIL' THEN 'FAIL' WHEN compliance_status IN ('MISSING', 'REVIEW') THEN 'REVIEW' WHEN compliance_status = 'PASS' AND integrity_status = 'CONSISTENT' AND n_items = 0 THEN 'PASS' ELSE 'REVIEW' END AS overall_status FROM (SELECT b.bid_id, coalesce(c.compliance_status, 'REVIEW') AS compliance_status, CASE WHEN coalesce(contradictions, 0) > 0 THEN 'CONTRADICTION' WHEN coalesce(integrity_reviews, 0) > 0 THEN 'REVIEW' ELSE 'CONSISTENT' END AS integrity_status, coalesce(d.debarred, false) AS debarred, coalesce(q.n, 0) AS n_items, coalesce(contradictions, 0) + coalesce(integrity_reviews, 0) + CASE WHEN coalesce(d.debarred, false) THEN 1 ELSE 0 END AS anomalies FROM bids b LEFT JOIN compliance c ON b.bid_id = c.bid_id LEFT JOIN integ i ON b.bid_id = i.bid_id LEFT JOIN debarment d ON b.bid_id = d.bid_id LEFT JOIN (SELECT bid_id, count(*) AS n FROM queue GROUP BY bid_id) q ON b.bid_id = q.bid_id))", "bids", "compliance", "integ", "debarment", "queue")
view("recommend", "SELECT bid_id, CASE WHEN fail THEN 'FAIL' WHEN look THEN 'REVIEW' ELSE 'PASS' END AS verdict, CASE WHEN fail OR NOT look OR contra > 0 OR lacking > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CAST(issues AS BIGINT) AS n_critical_issues FROM (SELECT *, debarred OR fails > 0 AS fail, issues > 0 OR level IN ('HIGH', 'CRITICAL') OR under_review > 0 OR final_score < 75 AS look FROM (SELECT s.bid_id, s.debarred, s.under_review, s.final_score, r.level, coalesce(f.fails, 0) AS fails, coalesce(p.lacking, 0) AS lacking, coalesce(i.high_contradictions, 0) AS contra, CASE WHEN s.debarred THEN 1 ELSE 0 END + coalesce(f.fails, 0) + coalesce(p.lacking, 0) + coalesce(i.high_contradictions, 0) + coalesce(c.bad, 0) AS issues FROM scores s JOIN risk r ON s.bid_id = r.bid_id LEFT JOIN (SELECT bid_id, count(*) AS fails FROM results WHERE status = 'FAIL' AND severity IN ('CRITICAL', 'MAJOR') GROUP BY bid_id) f ON s.bid_id = f.bid_id LEFT JOIN (SELECT bid_id, count(*) AS lacking FROM pend WHERE mandatory AND status = 'MISSING' GROUP BY bid_id) p ON s.bid_id = p.bid_id LEFT JOIN integ i ON s.bid_id = i.bid_id LEFT JOIN (SELECT bid_id, count(*) AS bad FROM checks WHERE status IN ('IDENTITY_MISMATCH', 'INACTIVE', 'UNAUTHORIZED', 'REVOKED', 'REVIEW', 'UNAVAILABLE', 'ERROR', 'UNVERIFIED') GROUP BY bid_id) c ON s.bid_id = c.bid_id))", "scores", "risk", "results", "pend", "integ", "checks")
