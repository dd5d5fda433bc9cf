"""Bulk normalisation of submitted and expected values, as Column expressions.

Null in, null out, except where a docstring says otherwise.  Nothing here raises under ANSI
mode: what cannot be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, scales and currencies of amounts, durations, booleans and absent values.
CURRENCIES = (r"rs\.?", "inr", "rupees")
SCALES = (("crores?|crs?", 10_000_000), ("lakhs?|lacs?", 100_000), ("millions?|m", 1_000_000), ("thousands?|k", 1_000))
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
TRUE_WORDS = ("true", "yes", "y", "1", "required", "submitted", "available", "valid", "compliant")
FALSE_WORDS = ("false", "no", "n", "0", "not required", "exempted", "not available", "invalid", "non-compliant", "na", "n/a")
ABSENT_WORDS = ("", "na", "n/a", "not available", "none", "null", "missing")
NO_DATE_WORDS = ("", "na", "n/a", "not available")
_TIME = r"\d{1,2}:\d{1,2}:\d{1,2}"
#: Date formats with the shape a text must have: a failed parse costs far more than the test.
DATE_FORMATS = {
    "yyyy-M-d": r"\d{4}-\d{1,2}-\d{1,2}", "d-M-yyyy": r"\d{1,2}-\d{1,2}-\d{4}", "d/M/yyyy": r"\d{1,2}/\d{1,2}/\d{4}", "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}", "d-MMM-yyyy": r"\d{1,2}-[A-Za-z]{3}-\d{4}",
    "d-MMMM-yyyy": r"\d{1,2}-[A-Za-z]{3,}-\d{4}", "yyyy-M-d'T'H:m:s": r"\d{4}-\d{1,2}-\d{1,2}T" + _TIME, "yyyy-M-d H:m:s": r"\d{4}-\d{1,2}-\d{1,2} " + _TIME, "d-M-yyyy H:m:s": r"\d{1,2}-\d{1,2}-\d{4} " + _TIME,
}
MONTHS_A_YEAR, DAYS_A_MONTH, DAYS_A_YEAR = 12, 30, 365


def _word(pattern: str) -> str:
    return rf"\b({pattern})\b"


def bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "|".join(("[?₹]", *CURRENCIES)), ""))


def scale(bare: Column) -> Column:
    out = F.lit(1)
    for words, factor in reversed(SCALES):
        out = F.when(F.regexp_like(bare, F.lit(_word(words))), factor).otherwise(out)
    return out


def plain(bare: Column, scale: Column) -> Column:
    rest = bare
    for words, factor in SCALES:
        rest = F.when(scale == factor, F.trim(F.regexp_replace(bare, _word(words), ""))).otherwise(rest)
    return F.trim(F.replace(rest, F.lit(","), F.lit("")))


def number(plain: Column, scale: Column) -> Column:
    left = F.regexp_replace(plain, r"[?$]|" + _word("|".join((*CURRENCIES, *[words for words, _ in SCALES]))), "")
    number = F.regexp_extract(plain, r"[-+]?\d*\.?\d+", 0).try_cast("decimal(28,6)")
    return F.when(~F.regexp_like(left, F.lit("[a-zA-Z]")), (number * scale.cast("decimal(9,0)")).cast("decimal(38,6)"))


def amount(c: Column) -> Column:
    """An amount as DECIMAL(38,6): currency words and thousands commas go, scale words multiply; other letters make it null."""
    text = bare(c)
    return number(plain(text, scale(text)), scale(text))


def date(c: Column) -> Column:
    """A date in one of nine formats, else the first ISO or day-month-year date inside the text."""
    text = F.trim(c)
    iso = F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    day_first = F.regexp_replace(F.regexp_extract(text, r"\b(\d{2}[-/]\d{2}[-/]\d{4})\b", 1), "/", "-")
    shaped = [F.when(F.regexp_like(text, F.lit(f"^{shape}$")), F.try_to_date(text, f)) for f, shape in DATE_FORMATS.items()]
    found = F.coalesce(*shaped, F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")), F.when(day_first != "", F.try_to_date(day_first, "dd-MM-yyyy")))
    return F.when(F.regexp_like(text, F.lit(r"\d")) & ~F.lower(text).isin(*NO_DATE_WORDS), found)


def spelled(c: Column) -> Column:
    text = F.lower(F.trim(c))
    for digit, word in enumerate(NUMBER_WORDS):
        text = F.regexp_replace(text, _word(word), str(digit))
    return text


def lasts(text: Column, unit: str) -> Column:
    n = F.regexp_extract(text, r"\b(\d+(?:\.\d+)?)\b", 1).try_cast("decimal(18,6)")
    times, over = {"MONTHS": ((MONTHS_A_YEAR, 1, 1), (1, 1, DAYS_A_MONTH)), "DAYS": ((DAYS_A_YEAR, DAYS_A_MONTH, 1), (1, 1, 1)), "YEARS": ((1, 1, 1), (1, MONTHS_A_YEAR, DAYS_A_YEAR))}[unit]
    of = lambda k: (n.cast("double") * times[k] / over[k]).try_cast("decimal(18,6)")
    years, months, days = (F.regexp_like(text, F.lit(_word(p))) for p in ("years?|yrs?|yr", "months?|mths?|mth|mo", "days?|d"))
    return F.when(years, of(0)).when(months, of(1)).when(days, of(2)).otherwise(n)


def duration(c: Column, unit: str = "MONTHS") -> Column:
    """A duration in MONTHS, DAYS or YEARS as DECIMAL(18,6); a bare number is taken to be in that unit."""
    return lasts(spelled(c), unit)


def boolean(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def categorical(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))


def exists(c: Column) -> Column:
    """Whether a value is there at all; never null."""
    return F.coalesce(~F.lower(F.trim(c)).isin(*ABSENT_WORDS), F.lit(False))


def field_key(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-./]+", "_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9_]", ""), r"_+", "_"), r"^_|_$", "")


def legal_name(c: Column) -> Column:
    """A company name for comparison across documents; null is empty."""
    name = F.trim(F.regexp_replace(F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), ".,", "  "), r"\s+", " "))
    for long, short in (("PRIVATE LIMITED", "PVT LTD"), ("LIMITED", "LTD"), ("L L P", "LLP"), ("INCORPORATED", "INC"), ("CORPORATION", "CORP")):
        name = F.regexp_replace(name, rf"\b{long}\b", short)
    return name


def registry_name(c: Column) -> Column:
    """A company name as registries are compared: dots and commas stay."""
    name = F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " "))
    for long, short in ((r"\bPVT\.? LTD\.?", "PRIVATE LIMITED"), (r"\bLTD\.?$", "LIMITED")):
        name = F.regexp_replace(name, long, short)
    return name


def lookup_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s", ""))


class Readings:
    """The columns that ``with_readings`` adds, by part: raw, num, months, day, flag, cat, present, name, issued, expires, void and, of expected values, members, low_num, high_num, low_day, high_day."""

    def __init__(self, prefix: str) -> None:
        self.prefix = prefix

    def __getitem__(self, part: str) -> Column:
        return F.col(f"{self.prefix}_{part}")


def _numbers(df: DataFrame, prefix: str, sources: dict[str, Column]) -> DataFrame:
    """Add amounts step by step, so that what several steps use is worked out once."""
    name = lambda part: f"{prefix}_{part}"
    df = df.withColumns({name(f"{k}_bare"): bare(c) for k, c in sources.items()})
    df = df.withColumns({name(f"{k}_scale"): scale(F.col(name(f"{k}_bare"))) for k in sources})
    df = df.withColumns({name(f"{k}_plain"): plain(F.col(name(f"{k}_bare")), F.col(name(f"{k}_scale"))) for k in sources})
    df = df.withColumns({name(k): number(F.col(name(f"{k}_plain")), F.col(name(f"{k}_scale"))) for k in sources})
    return df.drop(*[name(f"{k}_{x}") for k in sources for x in ("bare", "scale", "plain")])


def with_readings(df: DataFrame, c: Column, prefix: str, *, expected: bool = False) -> DataFrame:
    """``df`` with all readings of a value as columns ``<prefix>_<part>``.

    For expected values also the members of a list and the ends of a range (``low to high``
    or ``low-high``; a hyphen splits wherever it stands, so ranges of ISO dates need `` to ``).
    """
    raw = F.col(f"{prefix}_raw")
    df = df.withColumn(f"{prefix}_raw", c).withColumn(f"{prefix}_spelled", spelled(raw))
    sources = {"num": raw}
    if expected:
        parts = F.when(F.regexp_like(raw, F.lit(r"\s+to\s+")), F.split(raw, r"\s+to\s+")).otherwise(F.split(raw, "-"))
        df = df.withColumns({f"{prefix}_low": F.trim(F.get(parts, F.lit(0))), f"{prefix}_high": F.trim(F.get(parts, F.lit(1)))})
        ends = {k: F.col(f"{prefix}_{k}") for k in ("low", "high")}
        sources |= {f"{k}_num": x for k, x in ends.items()}
        df = df.withColumns({f"{prefix}_members": F.transform(F.split(raw, ","), categorical)} | {f"{prefix}_{k}_day": date(x) for k, x in ends.items()})
    df = _numbers(df, prefix, sources)
    record = F.when(raw.startswith("{"), raw)  # a certificate as a record of its dates
    of = lambda *names: F.coalesce(*[F.get_json_object(record, f"$.{x}") for x in names])
    readings = {"issued": date(of("issue_date")), "expires": date(of("expiry_date")), "void": F.coalesce(of("valid") == "false", F.lit(False)) | F.coalesce(of("is_valid") == "false", F.lit(False))}
    readings |= {"months": lasts(F.col(f"{prefix}_spelled"), "MONTHS"), "day": date(raw), "flag": boolean(raw), "cat": categorical(raw), "present": exists(raw), "name": legal_name(raw)}
    return df.withColumns({f"{prefix}_{k}": x for k, x in readings.items()}).drop(f"{prefix}_spelled", f"{prefix}_low", f"{prefix}_high")
