"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def spark_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests, the bench and ad-hoc use; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName("loomspace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    Read from ``spark.checkpoint.dir``. Only a single-process local session may do without it; it then gets a
    temporary folder that is removed when the interpreter ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="loomspace-")
    atexit.register(shutil.rmtree, found, True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage and outlives any executor, unlike a cached one. It is deleted when the driver ends.
    """
    at = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; whatever is written there is deleted when the driver ends."""
    folder = _tables(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{folder}/{uuid.uuid4().hex}"


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder; results that still read them must be done with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each session, for clusters whose workers don't have it."""
    sc = spark.sparkContext
    if getattr(sc, "_loomspace_shipped", False):
        return spark
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="loomspace-zip-")  # the driver serves this file to the executors
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(at := f"{folder}/loomspace.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"loomspace/{f.relative_to(root)}")
    sc.addPyFile(at)
    sc._loomspace_shipped = True
    return spark
