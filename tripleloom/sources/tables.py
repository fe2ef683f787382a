"""Relational tables as triples, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE = "urn:x:"
#: Tables in which the key column does not tell rows apart; the triples of the others are distinct as they are.
REPEATED = ("lineitem",)
#: Rows of such a table for a task that makes them distinct.
ROWS = 1_000_000
#: table -> (key column, kind, [(predicate, column, kind of the object or None for a literal)])
MAPPING = {
    "region": ("r_regionkey", "region", [("name", "r_name", None)]),
    "nation": ("n_nationkey", "nation", [("inRegion", "n_regionkey", "region"), ("name", "n_name", None)]),
    "customer": ("c_custkey", "cust", [("inNation", "c_nationkey", "nation"), ("name", "c_name", None), ("segment", "c_mktsegment", None)]),
    "supplier": ("s_suppkey", "supp", [("inNation", "s_nationkey", "nation"), ("name", "s_name", None)]),
    "part": ("p_partkey", "part", [("brand", "p_brand", None), ("type", "p_type", None), ("name", "p_name", None)]),
    "orders": ("o_orderkey", "order", [("placedBy", "o_custkey", "cust")]),
    "lineitem": ("l_orderkey", "order", [("hasPart", "l_partkey", "part"), ("suppliedBy", "l_suppkey", "supp")]),
}
PREDICATES = sorted({p for _, _, ps in MAPPING.values() for p, _, _ in ps})


def iri(kind: str, column):
    return F.concat(F.lit(f"<{BASE}{kind}/"), column.cast("string"), F.lit(">"))


def name(p: str) -> str:
    return f"<{BASE}{p}>"


def triples(spark: SparkSession, sf_dir: str, predicates=None) -> DataFrame:
    """Distinct s, p, o of the mapped tables; only tables and columns of the wanted predicates are read."""
    parts = []
    for table, (key, kind, columns) in MAPPING.items():
        wanted = [c for c in columns if predicates is None or c[0] in predicates]
        if not wanted:
            continue
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        for p, column, to in wanted:
            pairs = rows.select(key, column)
            if table in REPEATED:  # on the numbers, before any text is made
                n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), rows.count() // ROWS + 1)
                pairs = pairs.repartition(n, key, column).distinct()
            o = iri(to, F.col(column)) if to else F.concat(F.lit('"'), F.col(column), F.lit('"'))
            parts.append(pairs.select(iri(kind, F.col(key)).alias("s"), F.lit(name(p)).alias("p"), o.alias("o")).where("s is not null and o is not null"))
    return reduce(DataFrame.unionByName, parts)


def triples_sql(predicates=None) -> str:
    """The same triples in SQL."""
    parts = []
    for table, (key, kind, columns) in MAPPING.items():
        for p, column, to in columns:
            if predicates is None or p in predicates:
                o = f"'<{BASE}{to}/' || CAST({column} AS VARCHAR) || '>'" if to else f"'\"' || {column} || '\"'"
                parts.append(f"SELECT '<{BASE}{kind}/' || CAST({key} AS VARCHAR) || '>' AS s, '{name(p)}' AS p, {o} AS o FROM {table} WHERE {key} IS NOT NULL AND {column} IS NOT NULL")
    return "\nUNION\n".join(parts)


def table_of(graph: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Subjects as rows: one column for each predicate (a subject with several objects gives their smallest)."""
    picked = graph.where(F.col("p").isin([name(p) for p in columns]))
    return picked.groupBy("s").agg(*[F.min(F.when(F.col("p") == name(p), F.col("o"))).alias(c) for p, c in columns.items()])
