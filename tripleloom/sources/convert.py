"""Conversion between formats: text triples, encoded triples as Parquet, with any of Spark's codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..scratch import Scratch
from . import dictionary, ntriples


#: Formats: text triples, Parquet triples, encoded triples with a dictionary as Parquet or as files of records.
FORMATS = ("nt", "parquet", "encoded", "der")


def read(spark: SparkSession, path: str, fmt: str, dictionary_path: str | None = None) -> DataFrame:
    """Triples of a format; encoded ones take their dictionary from ``dictionary_path`` where it is shared by several inputs."""
    if fmt == "nt":
        return ntriples.read(spark, path)[0]
    if fmt == "parquet":
        return spark.read.parquet(path).select("s", "p", "o")
    if fmt == "encoded":
        return dictionary.decode(spark.read.parquet(f"{path}/triples"), spark.read.parquet(dictionary_path or f"{path}/dictionary"))
    if fmt == "der":
        return dictionary.decode(dictionary.read_der(spark, f"{path}/triples"), Scratch(spark, "convert").table(dictionary.read_dictionary(spark, dictionary_path or f"{path}/dictionary")))
    raise ValueError(f"unknown format {fmt}")


def write(triples: DataFrame, path: str, fmt: str, compression: str | None = None, single: bool = False, dictionary_path: str | None = None) -> None:
    """Write triples; ``single`` gives one part file. With ``dictionary_path`` terms are encoded by that dictionary,
    which must have them all, and none is written."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    one = lambda df: df.repartition(1) if single else df  # noqa: E731  what makes the rows is not done by that one task
    if fmt == "nt":
        return ntriples.write(one(triples), path, compression)
    if fmt == "parquet":
        return one(triples).write.option("compression", compression or "zstd").parquet(path)
    spark, known = triples.sparkSession, None
    if dictionary_path:
        known = dictionary.read_dictionary(spark, dictionary_path) if fmt == "der" else spark.read.parquet(dictionary_path)
        known = Scratch(spark, "convert").table(known)
        missing = dictionary.terms_of(triples).join(known, "term", "left_anti")
        if not missing.isEmpty():
            raise ValueError(f"the dictionary lacks {missing.first()['term']}")
    ids, d = dictionary.encode(triples, known)
    if fmt == "encoded":
        one(ids).write.parquet(f"{path}/triples")
        if known is None:
            d.write.parquet(f"{path}/dictionary")
    else:
        dictionary.write_der(one(ids), f"{path}/triples")
        if known is None:
            dictionary.write_dictionary(d, f"{path}/dictionary")


def convert(spark: SparkSession, src: str, src_fmt: str, dst: str | None, dst_fmt: str = "nt", source_dictionary: str | None = None, **options) -> int | None:
    """Read one format and write another. With ``dst`` None nothing is written: the triples are read, checked and counted."""
    triples = read(spark, src, src_fmt, source_dictionary)
    return triples.count() if dst is None else write(triples, dst, dst_fmt, **options)


def block_slice(rows: DataFrame, order: list[str], size: int, first: int, last: int) -> DataFrame:
    """Blocks ``first`` to ``last`` of ``size`` rows in the given order (no block index is needed: ranks are found by range partitions)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    count = dealt.groupBy("__part").agg(F.count("*").alias("c"))
    base = count.select("__part", (F.sum("c").over(Window.orderBy("__part")) - F.col("c")).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = dealt.withColumn("__rank", rank).join(F.broadcast(base), "__part")
    placed = placed.withColumn("block", F.floor((F.col("__base") + F.col("__rank") - 1) / size).cast("long"))
    return placed.where(F.col("block").between(first, last)).drop("__part", "__rank", "__base")
