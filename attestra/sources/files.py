"""Reading and writing record files: CSV, line-delimited JSON, partitioned Parquet, contracts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder; a temporary one only for a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="attestra-files-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing needs any more, through Spark's own file system layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for jobs whose Python workers need its functions."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="attestra-")) / "attestra-core.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(spark.sparkContext.applicationId)


def round_trip(df: DataFrame, kind: str, **options) -> DataFrame:
    """Write ``df`` as csv, json, orc or parquet and read it back under its own schema."""
    path = scratch(df.sparkSession, kind)
    df.write.options(**options).format(kind).save(path)
    return df.sparkSession.read.schema(df.schema).options(**options).format(kind).load(path)


def partitioned(df: DataFrame, by: str) -> str:
    """Write ``df`` partitioned by a column, so that a filter on it reads only its folders; gives the path."""
    path = scratch(df.sparkSession, "partitioned")
    df.repartition(by).write.partitionBy(by).parquet(path)
    return path


def by_id(df: DataFrame, key: str) -> str:
    """Write ``df`` in ascending order of ``key``, so that statistics of files and row groups lead a read by id to its rows; gives the path."""
    path = scratch(df.sparkSession, "by-id")
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
    return path


def contract_errors(df: DataFrame, required: list[str], members: dict[str, list[str]], least: dict[str, float], *, sizes: dict[str, int] | None = None, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with ``errors``: required values that lack, values outside an enumeration, numbers under a minimum, lists shorter than ``sizes``, maps with other keys than ``keys``."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in required]
    checks += [F.when(~F.col(c).isin(*some), F.lit(f"{c}: not allowed")) for c, some in members.items()]
    checks += [F.when(F.col(c) < n, F.lit(f"{c}: under minimum")) for c, n in least.items()]
    checks += [F.when(F.size(c) < n, F.lit(f"{c}: too few")) for c, n in (sizes or {}).items()]
    checks += [F.when(F.size(F.array_except(F.map_keys(c), F.array(*map(F.lit, some)))) > 0, F.lit(f"{c}: other keys")) for c, some in (keys or {}).items()]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def manifest(found: DataFrame) -> DataFrame:
    """(file, bytes, sha256, manifest) of a binary file source: ``manifest`` is the SHA-256 of all files' hashes in order, one for all.

    A file is a row, which bounds it to 2 GB; its bytes are hashed where they are read and go no further.
    """
    each = found.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    path = scratch(found.sparkSession, "manifest")
    each.write.parquet(path)
    each = found.sparkSession.read.schema(each.schema).parquet(path)
    whole = each.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "sha256"))), lambda x: F.concat_ws(":", x["file"], x["sha256"])), ";"), 256).alias("manifest"))  # a line a file
    return each.join(F.broadcast(whole))


def valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that keep the contract, without ``errors``, and those that do not, with them."""
    faulty = F.size("errors") > 0
    return checked.filter(~faulty).drop("errors"), checked.filter(faulty)
