"""The corpus tables of the engine, derived from the given tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Over all cores, if a table has fewer splits than there are: a small file is one split. Large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with status, media type and times."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"),
        "source",
        "lang",
        "text",
        "n_chars",
        F.when(F.col("doc_id") % 7 == 0, "text/html").otherwise("text/plain").alias("media_type"),
        F.when(F.col("n_chars") < 20, "no_extractable_text").when(F.col("doc_id") % 41 == 0, "failed").otherwise("indexed").alias("status"),
        (F.col("doc_id") % 53 == 0).alias("deleted"),
        (F.col("doc_id") * 60).alias("updated_s"),
        (F.col("doc_id") % 3).alias("publication_id"),
    )


DOCUMENTS = """docs AS (SELECT doc_id AS document_id, source, lang, text, n_chars,
  CASE WHEN doc_id % 7 = 0 THEN 'text/html' ELSE 'text/plain' END AS media_type,
  CASE WHEN n_chars < 20 THEN 'no_extractable_text' WHEN doc_id % 41 = 0 THEN 'failed' ELSE 'indexed' END AS status,
  doc_id % 53 = 0 AS deleted, doc_id * 60 AS updated_s, doc_id % 3 AS publication_id FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per line of a document; its heading is the document's source and language."""
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return d.select(
        F.concat_ws("-", "doc_id", "position").alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        "position",
        "text",
        F.concat_ws(" > ", "source", "lang").alias("heading_text"),
        word_count(F.col("text")).alias("token_count"),
        (F.col("doc_id") % 3).alias("publication_id"),
    )


CHUNKS = r"""chunks AS (SELECT doc_id || '-' || (p - 1) AS chunk_id, doc_id AS document_id, CAST(p - 1 AS INTEGER) AS position, t AS text,
  source || ' > ' || lang AS heading_text, CAST(len(regexp_extract_all(t, '\S+')) AS INTEGER) AS token_count, doc_id % 3 AS publication_id
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's whole text, as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector, as a query."""
    return vectors(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


#: Cosines of the query vectors with all vectors; folded left to right as the engine does.
COSINES = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
cosines AS (SELECT q.vec_id AS query_id, u.vec_id AS chunk_id, greatest(-1.0, least(1.0, list_dot_product(q.e, u.e))) AS score
  FROM u, u AS q WHERE q.vec_id % 50 = 0)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of both kinds, ``query_id, text, vec``: every question and every fiftieth vector, the fewer of them in turn."""
    b = table(spark, sf_dir, "benchmark")
    counts = b.agg(F.count(F.lit(1)).alias("n")).crossJoin(vector_queries(spark, sf_dir).agg(F.count(F.lit(1)).alias("m")))  # one row each
    every = counts.select("n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("n", "m") - 1)).alias("query_id")).where("n > 0 and m > 0")
    placed = every.select("query_id", (F.col("query_id") % F.col("n")).alias("item_id"), (F.col("query_id") % F.col("m") * 50).alias("vec"))
    return placed.join(b.select("item_id", "text"), "item_id").select("query_id", "text", "vec")


ASKED = """pairs AS (SELECT unnest(range((SELECT greatest((SELECT count(*) FROM benchmark), (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0))))) AS query_id),
both_asked AS (SELECT query_id, b.text, (query_id % (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0)) * 50 AS vec FROM pairs JOIN benchmark b ON b.item_id = query_id % (SELECT count(*) FROM benchmark))"""
