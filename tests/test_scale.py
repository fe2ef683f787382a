"""What must not grow with a table: expressions worked out again, tasks that hold it all."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tripleloom.operators import lists
from tripleloom.scratch import Scratch
from tripleloom.sources import convert, dictionary, ntriples, tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_worked_out_once(spark):
    df = entry.queries()["nt_roundtrip"](spark, SF)
    assert plan(df).count("uuid(") == 3  # a term each
    x = spark.createDataFrame([("[]", "<http://e/p>", '"é\\\\u00E9"@de'), ("_:a_b", "<http://e/p>", "<http://e/>é>")], "s string, p string, o string")
    line = ntriples.serialize(F.col("s"), F.col("p"), F.col("o"))
    rows = x.select(ntriples.parse(line).alias("t")).select("t.*").collect()
    assert [r["error"] for r in rows] == [None, None]
    assert rows[0]["s"].startswith("_:Q") and rows[0]["o"] == '"é\\\\u00E9"@de' and rows[1]["s"] == "_:ZaZ5Fb" and rows[1]["o"] == "<http://e/%3Eé>"


def test_pairs_of_a_key_are_not_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 3, raising=False)
    rows = [(k, "ab"[k % 2], "t") for k in range(20)] + [(k, "c", str(k)) for k in range(20, 25)] + [(30, None, "t"), (31, "a", "t")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = entry.queries()["owl_haskey"](spark, str(tmp_path))
    same = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and None not in a and a[1:] == b[1:]}
    assert sorted((int(r["s"][12:-1]), int(r["o"][12:-1])) for r in df.collect()) == sorted(same)
    made = plan(df).split("Generate")[0]
    assert "Aggregate" not in made and "Join" not in made  # nothing is done to the pairs once unfolded


def test_a_pair_of_several_keys_comes_once(spark):
    owl, rdf = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    rows = [("<c:1>", f"<{owl}hasKey>", "_:k"), ("<c:2>", f"<{owl}hasKey>", "_:k"), ("_:k", f"<{rdf}first>", "<p:1>"), ("_:k", f"<{rdf}rest>", f"<{rdf}nil>")]
    kind = {"<i:1>": "12", "<i:2>": "12", "<i:3>": "1", "<i:4>": "2"}
    values = {"<i:1>": "xy", "<i:2>": "xyz", "<i:3>": "x", "<i:4>": "xz"}
    rows += [(i, f"<{rdf}type>", f"<c:{c}>") for i in kind for c in kind[i]] + [(i, "<p:1>", f'"{v}"') for i in values for v in values[i]]
    g = spark.createDataFrame(rows, "s string, p string, o string")
    got = sorted(tuple(r) for r in lists.same_items(g, Scratch(spark, "t")).collect())
    assert got == sorted((a, b) for a in kind for b in kind if a != b and set(kind[a]) & set(kind[b]) and set(values[a]) & set(values[b]))


def test_a_frequent_term_is_not_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dictionary, "HOT", 50, raising=False)
    monkeypatch.setattr(dictionary, "FILE_BYTES", 1000, raising=False)
    rows = [(f"<i:{k}>", "<p:1>" if k % 9 else "<p:2>", f'"{k % 3}"' if k % 5 else f"<i:{k + 1}>") for k in range(1000)]
    g = spark.createDataFrame(rows, "s string, p string, o string")
    ids, d = dictionary.encode(g)
    terms = sorted({x for r in rows for x in r})
    assert sorted(tuple(r) for r in d.collect()) == list(enumerate(terms, 1))
    at = {t: k for k, t in enumerate(terms, 1)}
    assert sorted(tuple(r) for r in ids.collect()) == sorted(tuple(at[x] for x in r) for r in rows)
    back = dictionary.decode(ids, d)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    assert "SortMergeJoin" not in back._jdf.queryExecution().executedPlan().toString()
    dealt = dictionary._exchanged(g, d, "term", "id").rdd.glom().map(len).collect()
    assert max(dealt) < 500, dealt
    convert.write(g, f"file://{tmp_path}/w", "der", single=True)
    assert len(list((tmp_path / "w/triples").glob("*.der"))) == 1
    assert sorted(tuple(r) for r in convert.read(spark, f"file://{tmp_path}/w", "der").collect()) == sorted(rows)
    many = spark.range(30_000).coalesce(1).select(F.col("id").cast("string").cast("binary").alias("r"))
    assert dictionary.write_records(many, f"file://{tmp_path}/r", ".dct", 1000) == 30_000 and len(list((tmp_path / "r").glob("*.dct"))) > 2


def test_tasks_grow_with_the_rows_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 500, raising=False)
    g = tables.triples(spark, SF, ["hasPart"])
    assert g.rdd.getNumPartitions() >= 10 and g.count() == g.distinct().count()
