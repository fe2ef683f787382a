"""Relations over RDF lists, as joins and counts on unfolded lists.

Rules use them like other relations; the engine derives them from triples:

* ``item(l, x)``: x is a member of the list l;
* ``has_all(l, x)``: x has every member of l (an ``owl:intersectionOf``) as a type;
* ``path(l, x, y)``: y is reached from x along the members of l (an ``owl:propertyChainAxiom``), in their order;
* ``same_values(l, x, y)``: x and y, different and of the class that l is an ``owl:hasKey`` of, share a value of every member of l.

:func:`unfold` numbers the cells of all lists at once by pointer doubling, so that a list of
n cells takes log n joins, not n rounds of a fixpoint. Lists are schema, mostly few, but
nothing here holds them on the driver; they are broadcast only if a count allows it.
A list that does not end in ``rdf:nil``, or meets a cell twice, has items and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.parser import PREFIXES
from ..scratch import Scratch

TYPE, FIRST, REST, NIL = (f"<{PREFIXES['rdf']}{n}>" for n in ("type", "first", "rest", "nil"))
#: relation -> number of arguments
RELATIONS = {"item": 2, "has_all": 2, "path": 3, "same_values": 3}
#: relation -> property whose objects are the lists it is about
ABOUT = {n: f"<{PREFIXES['owl']}{p}>" for n, p in (("has_all", "intersectionOf"), ("path", "propertyChainAxiom"), ("same_values", "hasKey"))}
#: Rows of a counted table up to which it is broadcast.
SMALL = 50_000
#: Individuals of a group in a block, which are paired at once, and pairs for a task.
BLOCK, MADE = 1000, 10_000_000
#: Joins of a chain after which its paths are written.
CUT = 4


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small (counted from its footers)."""
    return F.broadcast(df) if df.count() <= SMALL else df


def unfold(triples: DataFrame, scratch: Scratch) -> DataFrame:
    """l, k, x, n, good: the member x at place k of the list l, its length, and whether it ends as lists should."""
    part = lambda p, a, b: triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    first, rest = scratch.table(part(FIRST, "c", "x")), scratch.table(part(REST, "c", "d"))
    cells = scratch.table(first.select("c").distinct())
    total = cells.count()
    named = triples.where(F.col("p") != REST).select(F.col("o").alias("c")).join(_small(cells), "c", "left_semi")
    heads = named.unionByName(cells.join(rest.select(F.col("d").alias("c")), "c", "left_anti")).distinct()
    place = scratch.table(heads.select(F.col("c").alias("l"), "c", F.lit(0).cast("long").alias("k")))
    hop, step = scratch.table(rest.where(F.col("d") != NIL).distinct()), 1
    while step <= total and not hop.isEmpty():
        on = place.join(hop, "c").select("l", F.col("d").alias("c"), (F.col("k") + step).alias("k"))
        place = scratch.table(place.unionByName(on).distinct())
        hop = scratch.table(hop.join(hop.select(F.col("c").alias("d"), F.col("d").alias("e")), "d").select("c", F.col("e").alias("d")).distinct())
        step *= 2
    ends = rest.where(F.col("d") == NIL).select("c", F.lit(True).alias("end")).distinct()
    size = place.join(ends, "c", "left").groupBy("l").agg((F.max("k") + 1).alias("n"), F.count("*").alias("m"), F.count_distinct("c").alias("u"), F.count_if("end").alias("e"))
    size = size.select("l", "n", ((F.col("e") == 1) & (F.col("m") == F.col("u")) & (F.col("m") == F.col("n"))).alias("good"))
    return scratch.table(place.join(first, "c").join(size, "l").select("l", "k", "x", "n", "good").distinct())


def members(cells: DataFrame, triples: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """The places (l, k, x, n) of the lists that a relation is about."""
    lists = triples.where(F.col("p") == ABOUT[name]).select(F.col("o").alias("l")).distinct()
    return scratch.table(cells.where("good").join(lists, "l", "left_semi").select("l", "k", "x", "n"))


def derive(name: str, cells: DataFrame, places: DataFrame | None, triples: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct rows (a0, a1, ...) of a relation; ``places`` are its :func:`members`."""
    if name == "item":
        return cells.select(F.col("l").alias("a0"), F.col("x").alias("a1")).distinct()
    p = _small(places)
    typed = triples.where(F.col("p") == TYPE).select("s", "o")
    if name == "has_all":
        hits = typed.join(p.withColumnRenamed("x", "o"), "o").select("l", "n", "k", "s").distinct()
        return hits.groupBy("l", "n", "s").agg(F.count("*").alias("c")).where("c = n").select(F.col("l").alias("a0"), F.col("s").alias("a1"))
    along = triples.join(p.withColumnRenamed("x", "p"), "p").select("l", "n", "k", "s", "o")
    if name == "path":
        return _paths(scratch.table(along.distinct()), places, scratch)
    owners = triples.where(F.col("p") == ABOUT[name]).select(F.col("s").alias("o"), F.col("o").alias("l"))
    keys = _keys(along, typed.join(owners, "o").select("l", "s").distinct())
    return _pairs(keys, ["l", "t"], ["l"], scratch).select(F.col("l").alias("a0"), F.col("x").alias("a1"), F.col("y").alias("a2"))


def same_items(triples: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct x, y, different, that a key says are the same: of one class, with a value in common for every member of its key.

    What the rule on keys finds in triples at once, without a closure: no relation is written, and pairs,
    whose number grows with the square of a group, are neither written nor dealt.
    """
    p = _small(members(unfold(triples, scratch), triples, "same_values", scratch))
    owners = triples.where(F.col("p") == ABOUT["same_values"]).select(F.col("s").alias("c"), F.col("o").alias("l")).distinct()
    typed = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("c")).join(owners, "c").select("c", "l", "s").distinct()
    along = triples.join(p.withColumnRenamed("x", "p"), "p").select("l", "n", "k", "s", "o")
    keys = _keys(along, typed.select("l", "s").distinct()).join(typed, ["l", "s"]).select("c", "l", "t", "s")
    return _pairs(keys, ["c", "l", "t"], [], scratch).select("x", "y")


def _keys(along: DataFrame, owned: DataFrame) -> DataFrame:
    """l, t, s: the combinations t of values that an individual has along a key."""
    along = along.join(owned, ["l", "s"], "left_semi")
    # the combinations of an individual's own values, one from each place; none where a place has no value
    each = along.groupBy("l", "n", "s").agg(F.collect_set(F.struct("k", "o")).alias("v"))
    grow = lambda acc, k: F.flatten(F.transform(acc, lambda t: F.transform(F.filter("v", lambda x: x["k"] == k), lambda x: F.concat(t, F.array(x["o"])))))
    keys = each.withColumn("t", F.explode(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.array(F.array().cast("array<string>")), grow)))
    return keys.select("l", "t", "s")


def _pairs(keys: DataFrame, by: list[str], out: list[str], scratch: Scratch) -> DataFrame:
    """Distinct rows (``out``, x, y) of different individuals that share a group, which ``by`` tells; ``keys`` are distinct rows (``by``, s).

    Groups are cut into blocks of about ``BLOCK`` on one side, so none is joined by one task, and a row is
    joined with a block at once, whose pairs are unfolded where they are used. A pair can come twice only if both stand in several groups; only such pairs are made distinct.
    """
    spark = keys.sparkSession
    keys = scratch.table(keys)
    groups = scratch.table(keys.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1").withColumn("g", F.monotonically_increasing_id()))
    often = keys.groupBy(*out, "s").agg((F.count("*") > 1).alias("many"))
    rows = keys.join(groups, by).select(*out, "s", "g", F.ceil(F.col("m") / BLOCK).cast("int").alias("b")).join(often, [*out, "s"])
    rows = scratch.table(rows)
    made = groups.agg(F.sum(F.col("m").cast("double") * F.col("m"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), int(made / MADE) + 1)
    left = rows.select(*out, "g", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("b"), F.col("s").alias("x"), "many").repartition(n, "g", "b")
    block = rows.select("g", F.pmod(F.hash("s"), F.col("b")).alias("b"), "s", "many").repartition(n, "g", "b").groupBy("g", "b")
    block = block.agg(F.collect_list("s").alias("all"), F.collect_list(F.when(~F.col("many"), F.col("s"))).alias("single"), F.collect_list(F.when(F.col("many"), F.col("s"))).alias("rest"))
    both = left.join(block, ["g", "b"])
    pairs = lambda rows, y: rows.select(*out, "x", F.explode(y).alias("y")).where("x <> y")
    if rows.where("many").isEmpty():
        return pairs(both, F.col("all"))
    once = pairs(both, F.when(F.col("many"), F.col("single")).otherwise(F.col("all")))
    return once.unionByName(pairs(both.where("many"), F.col("rest")).distinct())


def _paths(along: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    longest = places.agg(F.max("n")).first()[0] or 0
    now = along.where("k = 0").select("l", "n", "s", F.col("o").alias("at"))
    out = now.where("n = 1").select("l", "s", "at")
    for k in range(1, longest):
        step = along.where(F.col("k") == k).select("l", F.col("s").alias("at"), "o")
        now = now.where(F.col("n") > k).join(step, ["l", "at"]).select("l", "n", "s", F.col("o").alias("at")).distinct()
        if k % CUT == 0:
            now = scratch.table(now)
        out = out.unionByName(now.where(F.col("n") == k + 1).select("l", "s", "at"))
    return out.select(F.col("l").alias("a0"), F.col("s").alias("a1"), F.col("at").alias("a2")).distinct()
