"""Registered queries of includes, traces, bitmaps, ranges of lines and the bucketed vector store, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import anchors, bitmaps, embedding, includes, trace, vector_store
from folioforge.operators import retrieval as R
from folioforge.plans import corpus_queries as Q
from folioforge.plans import fixtures as fx
from folioforge.plans import retrieval_queries as Z
from folioforge.plans.registry import Registry
from folioforge.plans.scratch import new_dir, written

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

# --- includes ---

#: Every document begins with another one, some also end with one that isn't there; the first includes itself.
PAGES = r"""pages_ AS (SELECT doc_id::VARCHAR AS page, '{{include:' || (doc_id // 3) || '}}' || text || CASE WHEN doc_id % 10 = 4 THEN '{{include:gone}} end' ELSE '' END AS body FROM documents),
cut AS (SELECT page, string_split_regex(body, '\{\{include:[^{}]*\}\}') AS texts, regexp_extract_all(body, '\{\{include:([^{}]*)\}\}', 1) AS targets FROM pages_),
pieces AS (SELECT page, i, texts[i + 1] AS text, targets[i + 1] AS target FROM (SELECT *, unnest(range(len(texts))) AS i FROM cut)),
r AS (SELECT page AS root, [i] AS place, text, target, [page] AS trail FROM pieces
  UNION ALL SELECT r.root, list_append(r.place, p.i), p.text, p.target, list_append(r.trail, r.target) FROM r JOIN pieces p ON p.page = r.target WHERE NOT list_contains(r.trail, r.target) AND len(r.trail) <= 4)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    end = F.when(i % 10 == 4, "{{include:gone}} end").otherwise("")
    return fx.table(spark, sf_dir, "documents").select(i.cast("string").alias("page"), F.concat(F.lit("{{include:"), F.floor(i / 3), F.lit("}}"), "text", end).alias("body"))


@query(f"WITH RECURSIVE {PAGES} SELECT root AS page, length(b) AS n_chars, md5(b) AS body FROM (SELECT root, string_agg(text, '' ORDER BY place) AS b FROM r GROUP BY root)")
def src14_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: bodies with what they include put in, four pages deep."""
    body, _ = includes.spliced(_pages(spark, sf_dir), "page", "body", 4)
    return body.select("page", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body"))


@query(f"""WITH RECURSIVE {PAGES}, o AS (SELECT root, target, CASE WHEN target NOT IN (SELECT page FROM pages_) THEN 'missing' WHEN list_contains(trail, target) THEN 'cycle' WHEN len(trail) > 4 THEN 'too_deep' END AS reason FROM r WHERE target IS NOT NULL)
SELECT root AS page, target, reason, count(*) AS n FROM o WHERE reason IS NOT NULL GROUP BY ALL""")
def src14_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: includes that are left out, and why."""
    return includes.spliced(_pages(spark, sf_dir), "page", "body", 4)[1]


# --- traces ---

TOKENS = Z.TOK


@query(f"""WITH {Z.LEGS}, top AS (SELECT query_id, chunk_id, round(score, 12) AS score FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) <= 10),
rr AS (SELECT t.query_id, len(list_intersect(list_distinct({TOKENS.format("a.text")}), {TOKENS.format("d.text")})) / greatest(len(list_distinct({TOKENS.format("a.text")})), 1) AS score FROM top t JOIN documents d ON d.doc_id = t.chunk_id JOIN both_asked a USING (query_id))
SELECT 0 AS place, 'lexical' AS stage, count(*) AS n_rows, count(*) AS n_scored, round(min(score), 6) AS lowest, round(max(score), 6) AS highest FROM legs WHERE leg = 'lexical'
UNION ALL SELECT 1, 'dense', count(*), count(*), round(min(score), 6), round(max(score), 6) FROM legs WHERE leg = 'dense' UNION ALL SELECT 2, 'fusion', count(*), count(*), round(min(score), 6), round(max(score), 6) FROM fused
UNION ALL SELECT 3, 'rerank', count(*), count(*), round(min(score), 6), round(max(score), 6) FROM rr UNION ALL SELECT 4, 'assembly', count(DISTINCT query_id), 0, NULL, NULL FROM rr""")
def ret35_observed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-35: one search over all queries, whose stages are observed as their rows pass."""
    t, legs = trace.Trace(spark), Z.legs_of(spark, sf_dir)
    both = t.watch("lexical", legs.where("leg = 'lexical'")).unionByName(t.watch("dense", legs.where("leg = 'dense'")))
    fused = t.watch("fusion", R.rrf(both).drop("rank"))
    top = R.top_k(fused.withColumn("score", F.round("score", 12)), 10)
    docs = fx.table(spark, sf_dir, "documents")
    ranked = t.watch("rerank", R.overlap_rerank(top, docs.select(F.col("doc_id").alias("chunk_id"), "text"), fx.asked(spark, sf_dir), 10))
    sized = ranked.join(docs.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("n_chars") / 4).alias("token_count")), "chunk_id")
    written(t.watch("assembly", R.assembled(sized, 3000, 8), None), "assembled")
    return t.report().select("place", "stage", "n_rows", "n_scored", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


# --- memberships as bitmaps ---


def _bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manual and the ruled members of collections, and tags, as one table of bitmaps."""
    number = bitmaps.shifted(F.col("document_id")).alias("number")
    in_ = lambda rows, name, value: rows.select(F.lit(name).alias("dimension"), F.col(value).alias("value"), number)
    manual, ruled = (bitmaps.built(in_(m(spark, sf_dir), "collection", "collection_id")) for m in (Q.manual_members, Q.ruled_members))
    return written(bitmaps.merged(manual, ruled).unionByName(bitmaps.built(in_(Q.tagged_documents(spark, sf_dir), "tag", "tag"))), "bitmaps")


@query(Q.SQL["flt05_membership_scope"])
def flt05_bitmap_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05: OR in a dimension, AND across, on bitmaps."""
    found = bitmaps.scoped(_bitmaps(spark, sf_dir), {"collection": ("c1", "c2"), "tag": ("t1",)})
    return bitmaps.numbers(found).select((F.col("number") - 1).alias("document_id"))


@query(f"WITH {Q.D}, {Q.MANUAL}, {Q.RULED}, {Q.TAGGED}, m AS (SELECT 'collection' AS dimension, collection_id AS value, document_id FROM (SELECT * FROM manual UNION SELECT * FROM ruled) UNION ALL SELECT DISTINCT 'tag', tag, document_id FROM tagged) SELECT dimension, value, count(*) AS n_documents FROM m GROUP BY ALL")
def agg05_bitmap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, AGG-05: documents of each collection and tag, counted without their rows."""
    return bitmaps.counted(_bitmaps(spark, sf_dir), "dimension", "value")


@query(f"WITH s AS ({Q.SQL['flt05_membership_scope']}) SELECT count(*) AS n_documents FROM s")
def flt05_bitmap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05: how large a scope is, before anything is read."""
    return bitmaps.counted(bitmaps.scoped(_bitmaps(spark, sf_dir), {"collection": ("c1", "c2"), "tag": ("t1",)}))


# --- ranges of lines ---


@query(f"""WITH {fx.CHUNKS}, a AS (SELECT chunk_id, document_id, position AS s, position + document_id % 3 AS e FROM chunks), b AS (SELECT document_id, position AS s, position + (position * 7 + document_id) % 41 AS e FROM chunks),
p AS (SELECT a.chunk_id, b.s, b.e FROM a JOIN b ON a.document_id = b.document_id AND b.s <= a.s AND a.e <= b.e)
SELECT chunk_id, n_blocks, s AS block_start, e AS block_end FROM (SELECT chunk_id, s, e, count(*) OVER (PARTITION BY chunk_id) AS n_blocks, row_number() OVER (PARTITION BY chunk_id ORDER BY e - s, s) AS i FROM p) WHERE i = 1""")
def chk09_contained_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-09, CIT-03: the shortest block of lines that holds an anchor, and how many do."""
    c = fx.chunks(spark, sf_dir).select("chunk_id", "document_id", F.col("position").cast("long").alias("start"))
    a = c.withColumn("end", F.col("start") + F.col("document_id") % 3)
    b = c.select("document_id", "start", (F.col("start") + (F.col("start") * 7 + F.col("document_id")) % 41).alias("end"))
    return anchors.innermost(anchors.inside(a, b), ["chunk_id"])


# --- stored vectors ---


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents), old AS (SELECT DISTINCT h FROM a WHERE doc_id % 3 <> 0) SELECT doc_id AS chunk_id, CASE WHEN h IN (SELECT h FROM old) THEN 'reused' ELSE 'embedded' END AS origin, true AS same FROM a""")
def emb06_bucketed_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-06: two thirds of the documents are in the store; of all, only new texts are embedded, and get the vectors that they would get alone."""
    embed = embedding.hashing_embedder(16)
    store = vector_store.create(spark, f"vectors_{uuid.uuid4().hex}", new_dir(spark, "vectors"), 16)
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("identity"), F.col("text").alias("embed_text"))
    store.embed_or_reuse(docs.where("chunk_id % 3 <> 0"), embed)
    found = written(store.embed_or_reuse(docs, embed), "reused")
    alone = embedding.embedded(docs.select("chunk_id", "embed_text"), embed).select("chunk_id", F.col("vector").alias("alone"))
    return found.join(alone, "chunk_id").select("chunk_id", "origin", F.col("vector").eqNullSafe(F.col("alone")).alias("same"))
