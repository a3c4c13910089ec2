"""Tables between the steps of a plan: written once, read again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local runs and tests that don't set it a folder of our own, elsewhere that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sievewright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table; without a path of its own it lies in the shared folder until the driver ends."""
    spark = df.sparkSession
    at = path or f"{shared_dir(spark)}/sievewright/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite" if path else "errorifexists").parquet(at)
    if not path:

        def drop() -> None:
            with contextlib.suppress(Exception):  # the session may be gone by then; the folder's owner cleans it
                where = spark._jvm.org.apache.hadoop.fs.Path(at)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

        atexit.register(drop)
    return spark.read.schema(df.schema).parquet(at)
