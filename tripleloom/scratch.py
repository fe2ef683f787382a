"""Tables that cut lineage, in the folder that driver and executors share.

A lost executor costs a re-read, not a recomputation. Tables stay as long as results that
were made from them may be read, which is the life of the process; they are deleted at its
end, or when :func:`clean` is called.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and everything runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tripleloom.scratch", None)
    if not where:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        where = "file://" + tempfile.mkdtemp(prefix="tripleloom-scratch-")
        spark.conf.set("spark.tripleloom.scratch", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this process; results that rest on them cannot be read any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _clean_at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clean(spark)


atexit.register(_clean_at_end)


class Scratch:
    """Parquet tables of one job under the shared folder."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex[:12]}", 0
        _made.setdefault(spark.sparkContext.applicationId, []).append(self.base)

    def table(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df`` written, and read again."""
        self.n += 1
        path = f"{self.base}/{name or self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            _delete(self.spark, f"{self.base}/{n}")
