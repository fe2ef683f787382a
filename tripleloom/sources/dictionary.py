"""Dictionary encoding: terms to 64-bit ids and back, by equi-joins.

Ids are dense from 1 in the byte order of the terms, so the same terms always get the same
ids; 0 stays unused. The order comes from range partitions: a count by partition, whose
size is the number of partitions, gives each its first id, and no task sees all terms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..scratch import Scratch


#: Entries of a dictionary that one task holds, triples of a term in a column from which it is broadcast, and bytes of a dictionary file.
ENTRIES, HOT, FILE_BYTES = 500_000, 50_000, 32 << 20


def terms_of(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()


def build(triples: DataFrame) -> DataFrame:
    """id, term of every term of ``triples``."""
    spark = triples.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    at = F.monotonically_increasing_id()  # the partition, and in the low 33 bits the row's place in it
    dealt = terms_of(triples).repartitionByRange(n, "term").sortWithinPartitions("term").withColumn("at", at)
    dealt = Scratch(spark, "dictionary").table(dealt).select("term", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("k"))
    first = dealt.groupBy("part").agg(F.count("*").alias("c"))
    first = first.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("base"))
    return dealt.join(F.broadcast(first), "part").select((F.col("base") + F.col("k") + 1).cast("long").alias("id"), "term")


def encode(triples: DataFrame, dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(encoded s, p, o; dictionary)."""
    d = build(triples) if dictionary is None else dictionary
    out = _exchanged(triples, d, "term", "id")
    return out.where(" and ".join(f"{c}_id is not null" for c in "spo")).select(*[F.col(f"{c}_id").alias(c) for c in ("s", "p", "o")]), d


def _exchanged(triples: DataFrame, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """s, p, o and s_``value``, p_``value``, o_``value``: the ``value`` of each ``key``, null where the dictionary has none.

    A task holds the entries of its part of the dictionary, at most about ``ENTRIES`` of them; triples pass
    by unsorted. Keys of over ``HOT`` triples in a column are looked up once, broadcast (there are at
    most a ``HOT``-th as many as triples), and their triples are dealt by all three columns.
    """
    n = max(int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), dictionary.count() // ENTRIES + 1)
    out, columns = triples.select("s", "p", "o"), ["s", "p", "o"]
    for c in ("p", "o", "s"):
        new, hot = f"{c}_{value}", f"{c}_hot"
        often = triples.groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col(c).alias(key))
        often = dictionary.join(F.broadcast(often), key).select(F.col(key).alias(c), F.col(value).alias(hot))
        salt = F.when(F.col(hot).isNotNull(), 1 + F.pmod(F.hash("s", "p", "o"), F.lit(1 << 20))).otherwise(0)
        rows = out.join(F.broadcast(often), c, "left").withColumn("salt", salt).repartition(n, c, "salt")
        none = F.pmod(F.length(F.col(key).cast("string")), F.lit(1))  # 0; a literal would drop out of the join's keys
        entries = dictionary.select(F.col(key).alias(c), none.alias("salt"), F.col(value).alias("found")).repartition(n, c, "salt")
        columns.append(new)
        out = rows.join(entries.hint("shuffle_hash"), [c, "salt"], "left").withColumn(new, F.coalesce(hot, "found")).select(*columns)
    return out


def decode(encoded: DataFrame, dictionary: DataFrame, valid_only: bool = False) -> DataFrame:
    """Terms of ids; ids that the dictionary lacks are an error unless no row has one. ``valid_only`` drops what RDF does not allow."""
    out = _exchanged(Scratch(encoded.sparkSession, "decode").table(encoded.select("s", "p", "o")), dictionary, "id", "term")
    checked = [F.coalesce(F.col(f"{c}_term"), F.raise_error(F.concat(F.lit("unknown id "), F.col(c).cast("string"))).cast("string")).alias(c) for c in ("s", "p", "o")]
    out = out.select(*checked)
    return out.where(~F.col("s").startswith('"') & F.col("p").startswith("<")) if valid_only else out


def lookup(dictionary: DataFrame, wanted: list[str]) -> DataFrame:
    """id, term of the terms asked for."""
    return dictionary.where(F.col("term").isin(wanted))


# -- binary layouts -------------------------------------------------------------------------


def _long(h):
    """Signed long of 16 hexadecimal digits: halves, so that the top bit fits."""
    half = lambda x: F.conv(x, 16, 10).cast("long")
    return F.shiftleft(half(F.substring(h, 1, 8)), 32).bitwiseOR(half(F.substring(h, 9, 8)))


RECORD = 24


def read_der(spark: SparkSession, path) -> DataFrame:
    """s, p, o of files of 24-byte records (three big-endian 64-bit ids), split at whole records like any splittable input.

    Python only joins a split's records to larger rows; they are cut and decoded in the JVM.
    """
    def joined(records, n=4096):
        held = []
        for r in records:
            held.append(bytes(r))
            if len(held) == n:
                yield (b"".join(held),)
                held = []
        if held:
            yield (b"".join(held),)

    rows = spark.createDataFrame(spark.sparkContext.binaryRecords(path, RECORD).mapPartitions(joined), "content binary")
    n = F.floor(F.octet_length("content") / RECORD).cast("int")
    at = rows.select("content", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    h = at.select(F.hex(F.substring("content", F.col("k") * RECORD + 1, F.lit(RECORD))).alias("h"))
    return h.select(*[_long(F.substring("h", 16 * i + 1, 16)).alias(c) for i, c in enumerate("spo")])


def write_records(records: DataFrame, path: str, suffix: str, most: int | None = None) -> int:
    """Files of the bytes of ``records``' one column, one a partition, or more where a file reaches ``most`` bytes; returns how many records.

    Tasks write under names of their own in a folder beside, and only the files of the attempts
    that ended well are moved in, so a lost executor leaves nothing behind.
    """
    import pyarrow as pa

    spark = records.sparkSession
    tmp = f"{path}/_writing-{uuid.uuid4().hex[:12]}"
    (column,) = records.columns

    def run(batches):
        from pyarrow import fs

        name, n, size, out = None, 0, 0, None
        store, where = fs.FileSystem.from_uri(tmp)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}{suffix}", 0, 0
                    store.create_dir(where, recursive=True)
                    out = store.open_output_stream(f"{where}/{name}")
                some = b.column(0).slice(at, 4096).to_pylist()
                size, n = size + out.write(b"".join(some)), n + len(some)
                if most and size >= most:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    done = records.select(F.col(column).cast("binary")).mapInArrow(run, "name string, n long").orderBy("name").collect()  # bounded: a row a file
    folder = spark._jvm.org.apache.hadoop.fs.Path
    store = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder(path))
    for k, r in enumerate(done):
        store.rename(folder(f"{tmp}/{r['name']}"), folder(f"{path}/part-{k:05d}{suffix}"))
    store.delete(folder(tmp), True)
    return sum(r["n"] for r in done)


def write_der(encoded: DataFrame, path: str) -> int:
    """Encoded triples (s, p, o) as files of 24-byte records."""
    return write_records(encoded.select(der_record("s", "p", "o").alias("r")), path, ".der")


def write_dictionary(dictionary: DataFrame, path: str) -> int:
    """A dictionary (id, term) as files of records."""
    return write_records(dictionary.select(dictionary_record("id", "term").alias("r")), path, ".dct", FILE_BYTES)


def der_record(s, p, o):
    """24-byte record of three ids."""
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (s, p, o)]))


def dictionary_record(id_, term):
    """Record of a dictionary file: id, length of the term (32 bits, big-endian), its UTF-8 bytes."""
    raw = F.encode(term, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(id_), 16, "0")), F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")), raw)


def read_dictionary(spark: SparkSession, path) -> DataFrame:
    """id, term of dictionary files. Records have no fixed length, so a file is walked by one task; the writer ends one at ``FILE_BYTES``."""
    import struct

    import pyarrow as pa

    def run(batches):
        kinds = pa.schema([("id", pa.int64()), ("term", pa.string())])
        for b in batches:
            for raw in b.column("content").to_pylist():
                ids, names, at = [], [], 0
                while at + 12 <= len(raw):
                    i, n = struct.unpack_from(">qI", raw, at)
                    ids.append(i)
                    names.append(raw[at + 12 : at + 12 + n].decode("utf-8"))
                    at += 12 + n
                    if len(ids) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], schema=kinds)
                        ids, names = [], []
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], schema=kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, term string")
