from pyspark.sql import functions as F

from tripleloom.plans import programs
from tripleloom.streaming.incremental import SCHEMA, Maintained


def test_closure_follows_the_stream(spark, tmp_path):
    sub = "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"
    src = tmp_path / "in"
    spark.createDataFrame([("<a:1>", sub, "<a:2>")], SCHEMA).coalesce(1).write.parquet(str(src))
    kept = Maintained(spark, str(tmp_path / "closure"), programs.pick(programs.MINIMAL_RDFS, "scm-sco"))
    run = lambda: kept.start(spark.readStream.schema(SCHEMA).parquet(str(src)), str(tmp_path / "check")).awaitTermination()
    run()
    spark.createDataFrame([("<a:2>", sub, "<a:3>")], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert {(r["s"], r["o"]) for r in kept.triples().collect()} == {("<a:1>", "<a:2>"), ("<a:2>", "<a:3>"), ("<a:1>", "<a:3>")}
    assert kept.triples().groupBy("s", "p", "o").count().where(F.col("count") > 1).isEmpty()
