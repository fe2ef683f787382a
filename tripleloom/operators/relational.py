"""Joins, set operations, orders and offsets over relations, as plans that Catalyst finishes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import Scratch

#: A side is broadcast only below this many bytes, estimated by its rows.
BROADCAST_BYTES = 8 << 20
_ROW_BYTES = 200
#: Bits of a Bloom filter (1 MB).
BLOOM_BITS = 1 << 23


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def hash_join(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Equi-join with both sides dealt by the hash of the key."""
    return a.join(b.hint("shuffle_hash"), on or shared_columns(a, b))


def merge_join(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Equi-join of both sides dealt and sorted by the key."""
    return a.join(b.hint("merge"), on or shared_columns(a, b))


def replicated_join(a: DataFrame, b: DataFrame, on: list[str] | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``b`` on every executor if it is small; counted up to the limit first, else left to the planner."""
    rows = limit // _ROW_BYTES
    small = b.limit(rows + 1).count() <= rows
    return a.join(F.broadcast(b) if small else b, on or shared_columns(a, b))


def bloom_filter(rows: DataFrame, on: list[str], bits: int = BLOOM_BITS) -> DataFrame:
    """bucket, bits: a Bloom filter of the keys of ``rows`` with two hash functions, in bitmaps of 32768 bits; at most ``bits`` in all."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(*on, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]))
    keys = rows.where(" and ".join(f"`{c}` is not null" for c in on)).select(at.alias("h"))
    return keys.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))


def may_join(rows: DataFrame, bloom: DataFrame, on: list[str], bits: int = BLOOM_BITS) -> DataFrame:
    """Rows whose keys may be in a Bloom filter: all that are, and few others. The filter is broadcast; ``bits`` bounds it."""
    out = rows
    for seed in (1, 2):
        h = F.pmod(F.xxhash64(*on, F.lit(seed)), F.lit(bits))
        out = out.withColumn("__h", h).join(F.broadcast(bloom.withColumnRenamed("bits", "__bits")), F.bitmap_bucket_number("__h") == F.col("bucket"))
        place = F.bitmap_bit_position("__h").cast("int")
        byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out.where(F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1).select(*rows.columns)
    return out


def reduced_join(a: DataFrame, b: DataFrame, on: list[str] | None = None, bits: int = BLOOM_BITS) -> DataFrame:
    """Join of ``a``, cut by a Bloom filter of ``b``'s keys before it is shuffled, and ``b``."""
    keys = on or shared_columns(a, b)
    return may_join(a, bloom_filter(b, keys, bits), keys, bits).join(b, keys)


def delta_join(a: DataFrame, new_a: DataFrame, b: DataFrame, new_b: DataFrame, on: list[str]) -> DataFrame:
    """Distinct rows of the join of two relations that new rows of either make (``a`` and ``b`` hold their new rows too)."""
    left = new_a.join(b, on)
    return left.unionByName(a.join(new_b, on).select(*left.columns)).distinct()


def range_pairs(a: DataFrame, b: DataFrame, key: str, low: str, high: str, width: int) -> DataFrame:
    """Rows of ``a`` with ``key`` in ``[low, high]`` of a row of ``b``: equi-join on buckets of ``width``, then the test."""
    left = a.withColumn("__bucket", F.floor(F.col(key) / width))
    right = b.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.join(right, "__bucket").where((F.col(key) >= F.col(low)) & (F.col(key) <= F.col(high))).drop("__bucket")


def set_insert(known: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of ``more`` that are new."""
    return more.distinct().join(known, known.columns, "left_anti")


def set_retract(known: DataFrame, less: DataFrame) -> DataFrame:
    return known.join(less, known.columns, "left_anti")


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_novelty(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of the union, and how many of them ``a`` lacks."""
    both = a.withColumn("__new", F.lit(0)).unionByName(b.withColumn("__new", F.lit(1))).groupBy(*a.columns).agg(F.min("__new").alias("n"))
    return both.agg(F.count("*").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("novel"))


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], value: str, name: str = "start") -> DataFrame:
    """Exclusive running sums within groups."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def best(rows: DataFrame, order: list, n: int = 1) -> DataFrame:
    """The first rows in a total order; partial top-n in every task."""
    return rows.orderBy(*order).limit(n)


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """All rows with their place, from 1, in a total order: range partitions, and a count by partition; no task sees all rows."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = Scratch(spark, "ranked").table(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    first = dealt.groupBy("__part").agg(F.count("*").alias("c"))
    first = first.select("__part", (F.sum("c").over(Window.orderBy("__part")) - F.col("c")).alias("__base"))
    k = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__k", k).join(F.broadcast(first), "__part").withColumn(name, (F.col("__base") + F.col("__k")).cast("long")).drop("__part", "__base", "__k")


def randomize(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n)


def replicate(triples: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """(rows to have everywhere, the rest): what a replication condition selects; rows for which it is null are of the rest.

    On Spark a row is everywhere as the broadcast side of a join: :func:`replicated_join` does that where the rows are few.
    """
    yes = F.coalesce(condition, F.lit(False))
    return triples.where(yes), triples.where(~yes)


def schema_predicates(triples: DataFrame, predicates: list[str], limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(triples of the given predicates, with a broadcast hint if a count allows it; the rest): replication of a schema by its predicates."""
    few, rest = replicate(triples, F.col("p").isin(predicates))
    rows = limit // _ROW_BYTES
    return (F.broadcast(few) if few.limit(rows + 1).count() <= rows else few), rest
