"""Tables that several queries of one application start from, written once.

Facts, results and findings of all bids are what most queries roll up.  Such a table is written
to the shared folder when the first query needs it and read by the others; it belongs to the
input files as they are, so changed files give a new table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files

_WRITTEN: dict[tuple, tuple] = {}


def _state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size and time of change of all input files, those inside folders too, from Spark's own file system layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, found = jvm.org.apache.hadoop.fs.Path(sf_dir), []
    listed = where.getFileSystem(conf).listFiles(where, True)
    while listed.hasNext():
        x = listed.next()
        found.append((str(x.getPath()), x.getLen(), x.getModificationTime()))
    return tuple(sorted(found))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name`` made by ``build`` from the input in ``sf_dir``; ``by``: a folder for each value of these columns."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state_of(spark, sf_dir)
    known = _WRITTEN.get(key)
    if known is None or known[0] != state or not _exists(spark, known[1]):
        df, path = build(), files.scratch(spark, name)
        df.write.partitionBy(*by).parquet(path)
        if known is not None:  # of input that has changed since
            files.drop(spark, known[1])
        known = _WRITTEN[key] = state, path, df.schema
    return spark.read.schema(known[2]).parquet(known[1])


def once_written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` if a query before this one has written it, else what ``build`` gives, not written: for one pass over a table that is larger than what is made of it."""
    known = _WRITTEN.get((spark.sparkContext.applicationId, sf_dir, name))
    if known is not None and known[0] == _state_of(spark, sf_dir) and _exists(spark, known[1]):
        return spark.read.schema(known[2]).parquet(known[1])
    return build()


def release(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Delete what was written for ``sf_dir``, or for any input, when no result that starts from it is still to be read."""
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId and sf_dir in (None, k[1])]:
        files.drop(spark, _WRITTEN.pop(key)[1])
