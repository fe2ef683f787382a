"""The entry module: names, and a few queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["scan_triple_pattern_po", "multi_slot_frame", "not_list_contains", "join_shared_var", "set_difference", "dict_encode", "rdfs_subclass_trans", "owl_inverse", "rule_retract_assert", "iri_split", "prefix_sum_offsets", "block_slice", "bloom_semijoin", "semi_naive_delta_join", "nt_parse", "nt_files", "der_files", "convert_shared_dictionary", "iri_productions", "term_stats_all", "langtag_normalize", "order_terms", "owl_property_chain", "owl_maxcardinality_sameas", "owl_equality_replacement", "rdfs_practical_closure"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr([r[names.index(c)] for c in columns]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


def test_key_matches_among_all_parts(spark, tmp_path):
    rows = [(1, "b", "t"), (500, "b", "t"), (501, "b", "u"), (900, "c", "u"), (901, "c", "u")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(int(x.split("/")[1][:-1]) for x in (r["s"], r["o"])) for r in entry.queries()["owl_haskey"](spark, str(tmp_path)).collect()}
    assert got == {(1, 500), (500, 1), (900, 901), (901, 900)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_order_ranks_every_triple(spark):
    test_query_matches_sql(spark, "order_spo")
    assert entry.queries()["order_spo"](spark, SF).count() > 100


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from tripleloom import scratch

    class Conf:
        def __init__(self, **kv):
            self.kv = kv

        def get(self, k, default=None):
            return self.kv.get(k, default)

        def set(self, k, v):
            self.kv[k] = v

    class Session:
        conf = Conf(**{"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())
    Session.conf = Conf(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y/"})
    assert scratch.shared_dir(Session()) == "hdfs://x/y"
    s = scratch.Scratch(spark, "one")
    s.table(spark.range(3), "a")
    path = s.base.removeprefix("file://")
    assert os.path.isdir(f"{path}/a")
    s.drop("a")
    assert not os.path.isdir(f"{path}/a")


def test_bloom_filter_keeps_all_that_join(spark):
    from tripleloom.operators import relational as rel

    a, b = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 50).withColumnRenamed("id", "k")
    bloom = rel.bloom_filter(b, ["k"], 1 << 16)
    kept = {r["k"] for r in rel.may_join(a, bloom, ["k"], 1 << 16).collect()}
    assert {r["k"] for r in b.collect()} <= kept and len(kept) < 150
    assert rel.reduced_join(a, b).count() == 100
    odd = spark.createDataFrame([(1, None), (2, True), (3, False)], "s int, c boolean")
    yes, rest = rel.replicate(odd, odd.c)
    assert [r["s"] for r in yes.collect()] == [2] and sorted(r["s"] for r in rest.collect()) == [1, 3]
