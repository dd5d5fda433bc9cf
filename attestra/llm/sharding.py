"""Operator 11: reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows are numbered from 0 in the order of (doc_id, size, CRC of the text, hash of the row).
A Feistel network permutes the numbers below the next power of two; a result beyond the last
row walks the cycle, that is, it is permuted again until it falls below the number of rows,
which keeps the map one to one.  Place ``p`` lies in shard ``p % shards``, slot ``p // shards``,
so shards differ by one row at most (law ``rows``) and slots have no gaps.  Both ways can be
computed for a single row without any table: ``place_of`` and ``row_at`` are inverse.

Only DataFrame functions.  Texts are read once, for their size and CRC; numbers are dealt by
a sort of narrow rows, whose counts by partition give the offsets.  Rows that are equal sort
by where they lie, which the result does not show, so a third of all rows that are equal
still spreads over many partitions.

Defined results: a null text has no bytes (size 1, CRC 0); a null id comes first; rows that
repeat an id or a whole row have places of their own; an empty table gives an empty result;
other columns do not show in ``assigned``, and ``write_shards`` keeps them, whatever their names, in a struct.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import storage

SHARDS = 8
SEED = 11
ROUNDS = 8  # even, so that halves of unlike width end as they began
PRIME = (1 << 31) - 1
#: Steps of a walk in one expression; each goes on with a chance of less than a half, and what is left walks on in another pass.
STEPS = 64


def round_keys(seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """Four numbers below 2^31 - 1 a round, from the seed."""
    words = lambda k: hashlib.sha256(f"{seed}/{k}".encode()).digest()
    return [tuple(int.from_bytes(words(k)[8 * j : 8 * j + 8], "big") % (PRIME - 1) + 1 for j in range(4)) for k in range(ROUNDS)]


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and the right half for ``n`` rows; under 2^62 rows."""
    bits = max(n - 1, 0).bit_length()
    return bits // 2, bits - bits // 2


def _mixed(x: Column, key: Column) -> Column:
    """The round function: two linear steps modulo a prime, each followed by a shift; products stay below 2^62."""
    t = (x * key["a"] + key["b"]) % PRIME
    t = (t.bitwiseXOR(F.shiftright(t, 15)) * key["c"] + key["d"]) % PRIME
    return t.bitwiseXOR(F.shiftright(t, 13))


def _keys(n: int, seed: int, backward: bool) -> Column:
    left, right = widths(n)
    rows = [(*key, (1 << (right if k % 2 else left)) - 1) for k, key in enumerate(round_keys(seed))]
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("abcdm", row)]) for row in (reversed(rows) if backward else rows)])


def _once(x: Column, n: int, seed: int, backward: bool) -> Column:
    right = widths(n)[1]
    halves = F.struct(F.shiftright(x, right).alias("l"), x.bitwiseAND(F.lit((1 << right) - 1).cast("long")).alias("r"))

    def forth(s: Column, key: Column) -> Column:
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_mixed(s["r"], key).bitwiseAND(key["m"])).alias("r"))

    def back(s: Column, key: Column) -> Column:
        return F.struct(s["r"].bitwiseXOR(_mixed(s["l"], key).bitwiseAND(key["m"])).alias("l"), s["l"].alias("r"))

    return F.aggregate(_keys(n, seed, backward), halves, back if backward else forth, lambda s: F.shiftleft(s["l"], right).bitwiseOR(s["r"]))


def _walked(x: Column, n: int, seed: int, backward: bool = False) -> Column:
    """``x`` permuted once, and again while it is not below ``n``, up to ``STEPS`` times."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _once(x, n, seed, backward), lambda at, _: F.when(at < n, at).otherwise(_once(at, n, seed, backward)))


def _all_walked(df: DataFrame, start: str, out: str, n: int, seed: int, label: str, backward: bool = False) -> DataFrame:
    """A written table: ``df`` with ``out``, ``start`` walked to its end in as many passes as any row needs."""
    now, path = storage.written(df.withColumn(out, _walked(F.col(start), n, seed, backward)), label)
    while not now.filter(F.col(out) >= n).isEmpty():
        before = path
        now, path = storage.written(now.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(_walked(F.col(out), n, seed, backward))), label)
        storage.drop(df.sparkSession, before)
    return now


def place_of(rows: DataFrame, n: int, *, seed: int = SEED, row: str = "row_no", out: str = "place") -> DataFrame:
    """``rows`` with the place of each row number below ``n``."""
    return _all_walked(rows, row, out, n, seed, "places")


def row_at(places: DataFrame, n: int, *, seed: int = SEED, place: str = "place", out: str = "row_no") -> DataFrame:
    """``places`` with the row number that lies at each place below ``n``: the inverse of ``place_of``."""
    return _all_walked(places, place, out, n, seed, "rows", backward=True)


def numbered(docs: DataFrame, *, keep: bool = False) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row_no), ``keep``: also the whole ``row``; and how many rows there are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    narrow = [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(*hashed).alias("h")]
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    read, _ = storage.written(docs.select(*narrow, *whole), "shard-keys")
    shown = ["doc_id", "size", "text_crc32", *(["row"] if keep else [])]
    ordered = read.withColumn("at", F.monotonically_increasing_id()).orderBy("doc_id", "size", "text_crc32", "h", "at")
    dealt, _ = storage.written(ordered.select(*shown, F.monotonically_increasing_id().alias("m")), "shard-order")
    part, inside = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # a row a partition
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return dealt.withColumn("part", part).join(F.broadcast(before), "part").select(*shown, (F.col("before") + inside).alias("row_no")), dealt.count()


def assigned(docs: DataFrame, shards: int = SHARDS, *, seed: int = SEED, keep: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, row_no, place, shard, slot) of every row; ``keep``: also the whole ``row``."""
    if shards < 1:
        raise ValueError("shards: one at least")
    rows, n = numbered(docs, keep=keep)
    return place_of(rows, n, seed=seed).select("*", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, *, seed: int = SEED) -> None:
    """Write the rows as Parquet, a folder a shard, its files in the order of slots: (slot, size, text_crc32, row)."""
    rows = assigned(docs, shards, seed=seed, keep=True).select("shard", "slot", "size", "text_crc32", "row")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int, *, first: int = 0, last: int | None = None) -> DataFrame:
    """The rows of one shard with slots from ``first`` to before ``last``; folders and row groups outside are not read."""
    found = spark.read.parquet(path).filter(F.col("shard") == shard).filter(F.col("slot") >= first)
    return found if last is None else found.filter(F.col("slot") < last)


def oracle_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """DuckDB SQL of the query's rows, for tables whose ids differ: CRC by table, the rounds as nested selects, walks by recursion."""

    def permuted(source: str) -> str:
        at = f"(SELECT i, x >> rb AS l, x & ((1 << rb) - 1) AS r, lb, rb FROM {source})"
        for k, (a, b, c, d) in enumerate(round_keys(seed)):
            t = f"(SELECT *, (xor(u, u >> 15) * {c} + {d}) % {PRIME} AS t FROM (SELECT *, (r * {a} + {b}) % {PRIME} AS u FROM {at}))"
            at = f"(SELECT i, r AS l, xor(l, xor(t, t >> 13) & ((1 << {'rb' if k % 2 else 'lb'}) - 1)) AS r, lb, rb FROM {t})"
        return f"SELECT i, (l << rb) | r AS x, lb, rb FROM {at}"

    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), i)) AS t),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
n AS (SELECT count(*) AS n, CAST(length(bin(count(*) - 1)) AS BIGINT) AS bits FROM d),
dom AS (SELECT n, bits // 2 AS lb, bits - bits // 2 AS rb FROM n),
start AS (SELECT i, i AS x, lb, rb FROM d, dom),
walk(i, x, lb, rb) AS ({permuted("start")} UNION ALL {permuted("(SELECT walk.* FROM walk, n WHERE x >= n)")}),
place AS (SELECT i, x FROM walk, n WHERE x < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN place ON d.i = place.i, crc
"""
