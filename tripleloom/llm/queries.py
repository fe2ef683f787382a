"""The contract queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import tables_dir_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_dir_table(spark, sf_dir, "documents")


def _part(n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as held out."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates at similarity 0.85: a row for each row of ``documents``; cases as :func:`minhash.near_duplicate_rows` states."""
    from .minhash import near_duplicate_rows

    return near_duplicate_rows(_documents(spark, sf_dir), num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans counted and digested, and all spans, of every text; cases as :mod:`pii` states."""
    from .pii import find, report

    return report(find(_documents(spark, sf_dir)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that 200-byte strings which start elsewhere too cover, removed; cases as :mod:`suffix` states."""
    from .suffix import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text in sequences of 2048 tokens; cases as :mod:`packing` states."""
    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every row whose id 20 divides; cases as :mod:`topk` states."""
    from .topk import top_k

    return top_k(tables_dir_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each page, read as 8-bit PCM, stand in for recordings, which the tables lack."""
    from .media import match

    return match(tables_dir_table(spark, sf_dir, "pages"), "page_id", "html").withColumnRenamed("id", "page_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from three quarters of the ids; a null id is held out; cases as :mod:`langid` states."""
    from .langid import LangId

    docs = _documents(spark, sf_dir)
    held = F.coalesce(_part(4) == 2, F.lit(True))
    model = LangId().fit(docs.where(~held))
    return model.transform(docs).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from four fifths of the ids; a null id is held out; cases as :mod:`toxicity` states."""
    from .toxicity import Toxicity

    docs, labels = _documents(spark, sf_dir), tables_dir_table(spark, sf_dir, "labels")
    held = F.coalesce(_part(5) == 0, F.lit(True))
    model = Toxicity().fit(docs.where(~held), labels.where(~held))
    return model.transform(docs).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from four fifths of the ids; a null id is held out; cases as :mod:`quality` states."""
    from .quality import Quality

    docs, labels = _documents(spark, sf_dir), tables_dir_table(spark, sf_dir, "labels")
    held = F.coalesce(_part(5) == 0, F.lit(True))
    model = Quality(metadata=("n_chars",)).fit(docs.where(~held), labels.where(~held))
    return model.transform(docs).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text and what they decode to, as digests; cases as :mod:`pieces` states."""
    from .pieces import encode_documents

    return encode_documents(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_media": op6_media,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_sentencepiece": op10_sentencepiece,
}

_TOPK_SQL = """
WITH x AS (
  SELECT vec_id, i AS k, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM x q JOIN x c ON q.k = c.k AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY q.vec_id, c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NEAR_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), links AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e
), reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON least.a = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_minhash_dedup": _NEAR_SQL, "op5_topk": _TOPK_SQL}
