"""Intermediate tables that outlive an executor.

Lineage is cut by writing Parquet into the folder that the cluster names in
``spark.checkpoint.dir``; all machines share it, so a lost executor loses nothing.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    named = "file://" + tempfile.mkdtemp(prefix="attestra-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_HELD: dict[str, list[str]] = {}


def written(df: DataFrame, label: str, *, keep: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` and read it back; the path goes to ``drop`` once nothing needs it.

    Unless ``keep``, ``release`` deletes it too.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if not keep:
        _HELD.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Delete the tables written so far, when all results that were made from them are written themselves."""
    drop(spark, *_HELD.pop(spark.sparkContext.applicationId, []))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by ``written``, through Spark's own file system layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs; it does so when the driver collects garbage, which may be long after a loop of jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def prepare_python(spark: SparkSession) -> None:
    """Ready a session for Python workers.

    This package goes to the executors, once an application, and what one Arrow batch holds
    is bounded, as a text may be very long.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="attestra-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(application)
