"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may go without one; it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    kept = getattr(spark, "_tacita_dir", None)
    if kept is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        kept = tempfile.mkdtemp(prefix="tacita-")
        atexit.register(shutil.rmtree, kept, ignore_errors=True)
        spark._tacita_dir = kept
    return kept


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read from there. Survives lost executors. The
    shuffle files of its own run are deleted with the run's end, not when the garbage is next collected."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tacita-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tacita_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() that no later plan reads."""
    path = getattr(df, "_tacita_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """df and whether it has at most `limit` rows; reads at most limit + 1 rows of it."""
    return df, df.limit(limit + 1).count() <= limit


def broadcast_if(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint where df is known to have at most `limit` rows, else df as it is."""
    out, small = sized(df, limit)
    return F.broadcast(out) if small else out
