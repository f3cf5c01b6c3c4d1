"""Registered queries of the retrieval operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import ann, inverted
from folioforge.operators import retrieval as R
from folioforge.operators import store as T
from folioforge.plans import fixtures as fx
from folioforge.plans.scratch import written

QUERIES: dict = {}
SQL: dict[str, str] = {}

TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


BM25 = rf"""{fx.CHUNKS}, {fx.QUESTIONS},
asked AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, unnest({TOK.format("text")}) AS term FROM questions)),
lens AS (SELECT chunk_id, text, heading_text, len({TOK.format("text")}) + len({TOK.format("heading_text")}) AS dl FROM chunks),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
occ AS (SELECT chunk_id, dl, unnest({TOK.format("text")}) AS term, 1.0::DOUBLE AS w FROM lens UNION ALL SELECT chunk_id, dl, unnest({TOK.format("heading_text")}), 0.4::DOUBLE FROM lens),
tf AS (SELECT term, chunk_id, dl, sum(w) AS tf FROM occ WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT term, chunk_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM tf JOIN df USING (term), corpus),
hits AS (SELECT query_id, chunk_id, sum(part) AS score FROM asked JOIN parts USING (term) GROUP BY query_id, n_terms, chunk_id HAVING count(*) = n_terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits)"""


def _index(spark: SparkSession, sf_dir: str, stem: bool = False) -> inverted.InvertedIndex:
    """The chunks' index; the first query of a session over these files builds it."""
    return inverted.kept(fx.chunks(spark, sf_dir), "lines", R.Bm25(stem=stem))


def best_chunks(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return inverted.search(_index(spark, sf_dir), fx.questions(spark, sf_dir), k)


@query(f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def ret04_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_chunks(spark, sf_dir, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    rf"""WITH {fx.QUESTIONS}, t AS (SELECT query_id, list_filter(list_transform(string_split_regex(text, '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}\-_.'']', '', 'g')), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS ts FROM questions)
SELECT query_id, coalesce(array_to_string(list_transform(ts, lambda x: '"' || x || '"'), ' '), '') AS match FROM t"""
)
def ret02_match_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.questions(spark, sf_dir).select("query_id", R.escaped_match(F.col("text")).alias("match"))


@query(rf"WITH {fx.CHUNKS} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest({TOK.format('text')}) AS term FROM chunks) GROUP BY term")
def ret03_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_counts(fx.chunks(spark, sf_dir), X.tokens(F.col("text")))


@query(f"""WITH {fx.CHUNKS}, occ AS (SELECT chunk_id, unnest({TOK.format("text")}) AS term, 1.0::DOUBLE AS w FROM chunks UNION ALL SELECT chunk_id, unnest({TOK.format("heading_text")}), 0.4::DOUBLE FROM chunks)
SELECT term, count(*) AS n_chunks, round(sum(tf), 4) AS frequency, round(max(tf), 4) AS highest FROM (SELECT term, chunk_id, sum(w) AS tf FROM occ GROUP BY ALL) GROUP BY term""")
def ret03_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-03: what the kept index has written of each term: its posting lists, from all blocks."""
    return inverted.summed(_index(spark, sf_dir)).groupBy("term").agg(F.sum("n").alias("n_chunks"), F.round(F.sum("f"), 4).alias("frequency"), F.round(F.max("m"), 4).alias("highest"))


#: Queries of one term, which no rarer term cuts down: every word of the first twenty terms by code point of a question.
SINGLE = rf"single AS (SELECT DISTINCT term AS query_id, term AS text FROM (SELECT unnest(list_slice(list_sort(list_distinct({TOK.format('text')})), 1, 20)) AS term FROM benchmark))"


@query(f"WITH {BM25.replace(fx.QUESTIONS, SINGLE).replace('FROM questions', 'FROM single')} SELECT query_id, chunk_id, round(round(score, 9), 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def ret04_single_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-04: one-term queries, in which the bounds of blocks decide what is read."""
    terms = F.slice(F.array_sort(F.array_distinct(X.tokens(F.col("text")))), 1, 20)
    asked = fx.table(spark, sf_dir, "benchmark").select(F.explode(terms).alias("query_id")).distinct().select("query_id", F.col("query_id").alias("text"))
    return inverted.search(_index(spark, sf_dir), asked, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def ret03_stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over Porter stems without marks; stems run in Arrow batches."""
    return inverted.search(_index(spark, sf_dir, stem=True), fx.questions(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


DENSE = f"WITH {fx.COSINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cosines"


@query(f"{DENSE}) SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def ret09_dense_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.dense_exact(fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), 12).drop("rank")
    return R.top_k(found, 10, digits=9).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(SQL["ret09_dense_exact"])
def ret05_dense_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.dense_batched(fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), 12).drop("rank")
    return R.top_k(found, 10, digits=9).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"{DENSE} WHERE greatest(score, 0) >= 0.35) SELECT query_id, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 20")
def flt12_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.dense_batched(fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), 25, 0.35).drop("rank")
    return R.top_k(found, 20, digits=9).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey AS id, 10 AS k, round(least(greatest(ceil(10 / least(greatest((o_orderkey % 100) / 100.0, 0.05), 1.0)), 30), 200, 2000), 0)::BIGINT AS fetch FROM orders")
def ret06_over_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.lit(10).alias("k"), R.over_fetch(F.lit(10), (F.col("o_orderkey") % 100) / 100.0).cast("long").alias("fetch"))


VISIBLE = "visible AS (SELECT document_id, publication_id FROM docs WHERE status = 'indexed' AND NOT deleted)"


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are indexed and not deleted, with the publication that is theirs."""
    return fx.documents(spark, sf_dir).where("status = 'indexed' and not deleted").select("document_id", "publication_id")


@query(f"WITH {fx.CHUNKS}, {fx.DOCUMENTS}, {VISIBLE} SELECT (SELECT count(*) FROM chunks JOIN visible USING (document_id, publication_id)) AS live, (SELECT count(*) FROM chunks) AS stored, round((SELECT count(*) FROM chunks JOIN visible USING (document_id, publication_id)) / greatest((SELECT count(*) FROM chunks), 1), 6) AS fraction")
def ret08_live_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.live_fraction(fx.chunks(spark, sf_dir), visible(spark, sf_dir))


@query(f"WITH {fx.CHUNKS}, {fx.DOCUMENTS}, {VISIBLE} SELECT chunk_id, document_id, publication_id, token_count FROM chunks JOIN visible USING (document_id, publication_id)")
def flt08_visible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-11, FLT-08 and JOI-02: hydration against the documents' own publication."""
    return T.hydrated(fx.chunks(spark, sf_dir), visible(spark, sf_dir)).select("chunk_id", "document_id", "publication_id", "token_count")


LEGS = f"""{BM25.replace("FROM questions", "FROM both_asked").replace(fx.QUESTIONS, fx.ASKED)}, {fx.COSINES},
lexical AS (SELECT query_id, 'lexical' AS leg, document_id AS chunk_id, max(round(score, 9)) AS score FROM hits JOIN chunks USING (chunk_id) GROUP BY ALL),
dense AS (SELECT a.query_id, 'dense' AS leg, c.chunk_id, round(c.score, 9) AS score FROM both_asked a JOIN cosines c ON c.query_id = a.vec),
legs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, chunk_id) AS r FROM (SELECT * FROM lexical UNION ALL SELECT * FROM dense)) WHERE r <= 50),
fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score, count(*) AS n_legs FROM legs GROUP BY ALL)"""


def legs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their best chunk, and the vectors of the same ids: fifty of each leg."""
    asked = fx.asked(spark, sf_dir)
    # Queries of one text are searched once: there are as many as vectors ask, and far fewer texts.
    texts = asked.groupBy("text").agg(F.min("query_id").alias("query_id"))
    hits = inverted.search(_index(spark, sf_dir), texts, None)
    best = R.top_k(R.best_of_documents(hits, F.substring_index("chunk_id", "-", 1).cast("long")), 50).drop("rank").withColumnRenamed("query_id", "first")
    lexical = asked.join(texts.withColumnRenamed("query_id", "first"), "text").join(best, "first").select("query_id", "chunk_id", "score", F.lit("lexical").alias("leg"))
    # Some more than fifty, as ranks are by rounded scores.
    near = R.dense_batched(fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), 60).withColumnRenamed("query_id", "vec")
    dense = near.join(asked.select("query_id", "vec"), "vec").select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.lit("dense").alias("leg"))
    order = Window.partitionBy("query_id", "leg").orderBy(F.desc("score"), "chunk_id")
    return lexical.unionByName(dense).withColumn("r", F.row_number().over(order)).where("r <= 50").drop("r")


@query(f"WITH {LEGS} SELECT query_id, chunk_id, round(score, 6) AS score, n_legs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM fused) WHERE rank <= 10")
def ret13_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.rrf(legs_of(spark, sf_dir)).drop("rank").withColumn("score", F.round("score", 12))
    return R.top_k(fused, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "n_legs")


QUERIES["flagship"] = ret13_hybrid_rrf
SQL["flagship"] = SQL["ret13_hybrid_rrf"]


@query(f"WITH {LEGS} SELECT query_id, count(*) FILTER (leg = 'lexical') AS n_lexical, count(*) FILTER (leg = 'dense') AS n_dense, count(*) - count(DISTINCT chunk_id) AS overlap, count(DISTINCT leg) < 2 AS degraded FROM legs GROUP BY query_id")
def ret35_fusion_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.leg_counts(legs_of(spark, sf_dir))


@query(f"""WITH {LEGS}, a AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS position FROM legs WHERE leg = 'dense'),
b AS (SELECT * FROM legs WHERE leg = 'lexical'), m AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.position AS old, a.score AS dense, b.score AS lexical FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY old NULLS LAST, lexical DESC, chunk_id) - 1 AS INTEGER) AS position, round(dense, 6) AS dense, round(lexical, 6) AS lexical FROM m""")
def ret12_union_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = legs_of(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    dense = legs.where("leg = 'dense'").select("query_id", "chunk_id", (F.row_number().over(order) - 1).alias("position"), F.create_map(F.lit("dense"), "score").alias("scores"))
    out = R.union_scored(dense, legs.where("leg = 'lexical'"), "lexical")
    return out.select("query_id", "chunk_id", "position", F.round(F.col("scores")["dense"], 6).alias("dense"), F.round(F.col("scores")["lexical"], 6).alias("lexical"))


@query(f"""WITH {LEGS}, r AS (SELECT query_id, chunk_id, score, leg, r AS rank FROM legs),
p AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM r WHERE leg = 'lexical' AND rank BETWEEN 4 AND 5),
m AS (SELECT query_id, chunk_id, score, rank AS place FROM p UNION ALL SELECT query_id, chunk_id, score, 1000000 + 2 * rank FROM r WHERE leg = 'dense' UNION ALL SELECT query_id, chunk_id, score, 1000001 + 2 * rank FROM r WHERE leg = 'lexical'),
g AS (SELECT query_id, chunk_id, min(place) AS place, max(score) AS score FROM m GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS rank FROM g) WHERE rank <= 10""")
def ret23_merge_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("query_id", "leg").orderBy(F.desc("score"), "chunk_id")
    legs = legs_of(spark, sf_dir).withColumn("rank", F.row_number().over(order))
    lexical = legs.where("leg = 'lexical'")
    promoted = lexical.where("rank between 4 and 5").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return R.merge_rankings(legs.where("leg = 'dense'"), lexical, promoted, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {BM25}, r AS (SELECT * FROM ranked WHERE rank <= 3), defs AS (SELECT query_id, chunk_id, 0.5 + (query_id % 3) / 10.0 AS confidence FROM ranked WHERE rank IN (1, 5))
SELECT d.query_id, d.chunk_id, round(coalesce(r.score, 0), 6) AS score, CAST(row_number() OVER (PARTITION BY d.query_id ORDER BY confidence DESC, d.chunk_id) AS INTEGER) AS rank, r.score IS NULL AS cold
FROM defs d JOIN chunks c USING (chunk_id) LEFT JOIN r ON r.query_id = d.query_id AND r.chunk_id = d.chunk_id WHERE c.document_id % 2 = 0""")
def ret24_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_chunks(spark, sf_dir, 5)
    defs = found.where("rank in (1, 5)").select("query_id", "chunk_id", (0.5 + F.col("query_id") % 3 / 10.0).alias("confidence"))
    visible = fx.chunks(spark, sf_dir).where("document_id % 2 = 0")
    return R.promoted(defs, found.where("rank <= 3"), visible).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "cold")


@query(f"""WITH {BM25}, head AS (SELECT * FROM ranked WHERE rank <= 20),
s AS (SELECT h.query_id, h.chunk_id, len(list_intersect(list_distinct({TOK.format("q.text")}), {TOK.format("c.text")})) / greatest(len(list_distinct({TOK.format("q.text")})), 1) AS score FROM head h JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id))
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s""")
def ret14_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlap_rerank(best_chunks(spark, sf_dir, 20), fx.chunks(spark, sf_dir), fx.questions(spark, sf_dir), 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


GREETINGS, UTILITIES = ("hello", "hi", "thanks", "thank you", "good morning"), ("list documents", "how many documents", "index status")


@query(
    r"""WITH q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Hello!' WHEN 1 THEN '  How  many documents? ' WHEN 2 THEN 'thank you.' ELSE text END AS text FROM conversations),
n AS (SELECT *, trim(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[\s.!?,;:]+$', '')) AS key FROM q)
SELECT conv_id, turn, CASE WHEN length(trim(text)) <= 40 AND key IN ('list documents', 'how many documents', 'index status') THEN 'utility' WHEN length(trim(text)) <= 40 AND key IN ('hello', 'hi', 'thanks', 'thank you', 'good morning') THEN 'greeting' ELSE 'retrieve' END AS route FROM n"""
)
def ret16_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "conversations")
    t = F.col("turn") % 4
    q = c.select("conv_id", "turn", F.when(t == 0, "Hello!").when(t == 1, "  How  many documents? ").when(t == 2, "thank you.").otherwise(F.col("text")).alias("text"))
    return R.routed(q, GREETINGS, UTILITIES).select("conv_id", "turn", "route")


@query(f"""WITH RECURSIVE {BM25}, c AS (SELECT query_id, rank, token_count AS t, r.chunk_id FROM ranked r JOIN chunks USING (chunk_id) WHERE rank <= 12),
f AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS kept, 0 AS skipped FROM c WHERE rank = 1
  UNION ALL SELECT c.query_id, c.rank, CASE WHEN used + t <= 300 THEN used + t ELSE used END, CASE WHEN used + t <= 300 THEN kept + 1 ELSE kept END, CASE WHEN used + t <= 300 THEN skipped ELSE skipped + 1 END FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.rank + 1)
SELECT query_id, used AS token_count, kept AS n_passages, skipped > 0 AS truncated, (SELECT t > 300 FROM c WHERE c.query_id = f.query_id AND c.rank = 1) AS refused FROM f WHERE rank = (SELECT max(rank) FROM c WHERE c.query_id = f.query_id)""")
def ret25_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_chunks(spark, sf_dir, 12).join(fx.chunks(spark, sf_dir).select("chunk_id", "token_count"), "chunk_id")
    return R.assembled(found, 300, 12).select("query_id", "token_count", "n_passages", "truncated", "refused")


PASSAGES = """passages AS (SELECT query_id, chunk_id // 5 AS document_id, chunk_id, score AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, 1 + chunk_id % 2 AS n_legs, CASE WHEN query_id % 100 = 0 THEN score * 4 - 1 END AS logit FROM cosines WHERE chunk_id <> query_id QUALIFY rank <= 8)"""
EVID = "greatest(least((greatest(cosine, 0) - 0.4) / (0.65 - 0.4), 1.0), 0.0)"


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.dense_batched(fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), 10).where("chunk_id <> query_id").drop("rank")
    p = R.top_k(p, 8)
    return p.select("query_id", F.floor(F.col("chunk_id") / 5).alias("document_id"), "chunk_id", F.col("score").alias("cosine"), "rank", (1 + F.col("chunk_id") % 2).alias("n_legs"), F.when(F.col("query_id") % 100 == 0, F.col("score") * 4 - 1).alias("logit"))


@query(f"""WITH {fx.COSINES}, {PASSAGES}, e AS (SELECT *, {EVID} AS e FROM passages),
votes AS (SELECT query_id, document_id, max(e) AS vote FROM e GROUP BY ALL), sim AS (SELECT query_id, 1 - product(1 - vote) AS similarity FROM votes GROUP BY query_id),
rest AS (SELECT query_id, coalesce(avg(CASE WHEN e > 0 THEN CASE WHEN n_legs >= 2 THEN 1.0 ELSE 0.0 END END), 0.0) AS share, avg(1 / (1 + exp(-logit))) AS rerank FROM e GROUP BY query_id),
o AS (SELECT query_id, similarity, share * similarity AS agreement, rerank, 0.55 * similarity + 0.15 * share * similarity + 0.3 * coalesce(rerank, 0) AS score, 0.7 + CASE WHEN rerank IS NULL THEN 0 ELSE 0.3 END AS ceiling FROM sim JOIN rest USING (query_id))
SELECT query_id, round(similarity, 6) AS similarity, round(agreement, 6) AS agreement, round(rerank, 6) AS rerank, round(score, 6) AS score, round(ceiling, 6) AS ceiling, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' WHEN score >= 0.1 THEN 'low' ELSE 'none' END AS band FROM o""")
def ret32_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.Confidence(low=0.4).scored(_passages(spark, sf_dir))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("similarity", "agreement", "rerank", "score", "ceiling")], "band")


@query(f"WITH {fx.COSINES}, {PASSAGES} SELECT query_id, chunk_id, document_id, round({EVID}, 6) AS evidence, row_number() OVER (PARTITION BY query_id, document_id ORDER BY {EVID} DESC, rank) = 1 AS counted FROM passages")
def ret33_explain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.Confidence(low=0.4).explained(_passages(spark, sf_dir)).select("query_id", "chunk_id", "document_id", F.round("evidence", 6).alias("evidence"), "counted")


@query("SELECT n_nationkey AS id, CASE WHEN 2000 + n_nationkey * 300 + 1000 + 800 > 8192 THEN 2000 + n_nationkey * 300 + 1000 + 800 - 8192 END AS over FROM nation")
def ret27_window_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), R.window_problem(F.lit(2000), F.col("n_nationkey") * 300, F.lit(1000), F.lit(800), F.lit(8192)).alias("over"))


@query("""SELECT o_orderstatus AS status, count(*) AS rows, CASE WHEN count(*) < 5000 THEN 'exhaustive' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'ready' END AS lifecycle, greatest(floor(sqrt(count(*))), 1)::BIGINT AS partitions FROM orders GROUP BY o_orderstatus""")
def ret10_ann_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("rows"))
    indexed = F.when(F.col("status") != "O", F.col("rows"))
    return per.select("status", "rows", R.ann_lifecycle(F.col("rows"), indexed, 5000).alias("lifecycle"), R.ann_partitions(F.col("rows")).alias("partitions"))


@query(f"WITH {fx.DOCUMENTS} SELECT status, count(*) AS n FROM docs WHERE NOT deleted GROUP BY status")
def ret17_utility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.status_counts(fx.documents(spark, sf_dir))


@query(f"WITH {fx.COSINES}, n AS (SELECT query_id, count(*) FILTER (greatest(score, 0) >= 0.35) AS n FROM cosines GROUP BY query_id) SELECT query_id, least(n, 8) AS n, CASE WHEN n >= 8 THEN 'satisfied' ELSE 'exhausted_corpus' END AS outcome FROM n")
def ret07_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-07: an exact search ends satisfied or with the corpus exhausted, never by a guess."""
    asked = fx.vector_queries(spark, sf_dir)
    return R.outcomes(asked, R.dense_batched(fx.vectors(spark, sf_dir), asked, 8, 0.35), 8)


@query(f"WITH {fx.CHUNKS} SELECT chunk_id, CAST(floor(token_count * 1.2) AS BIGINT) + 1 AS estimate, floor(token_count * 1.2) + 1 < length(text) / 4.0 * 0.85 AS drifted FROM chunks")
def ret26_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-26: what a passage takes of a context, and where that falls short of a rule by characters."""
    c = fx.chunks(spark, sf_dir)
    estimate = R.context_tokens(F.col("token_count"))
    return c.select("chunk_id", estimate.alias("estimate"), R.drifted(estimate, F.length("text") / 4.0).alias("drifted"))


@query("SELECT vec_id AS chunk_id, 1 AS n FROM embeddings")
def ret10_ann_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-10: the built index holds every vector once."""
    index = ann.build(fx.vectors(spark, sf_dir))
    return index.table(spark).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS query_id, 10 AS n, true AS finds_itself FROM embeddings WHERE vec_id % 50 = 0")
def ret10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-10: a search of the index over as many partitions as reach a recall of 0.9 on the stated queries."""
    v, q = fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    index = ann.build(v)
    probes, reached = ann.calibrated(spark, index, v, q, 10)
    if reached < 0.9:
        raise RuntimeError(f"recall {reached} with all {probes} partitions")
    found = ann.search(spark, index, q, 10, probes)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if((F.col("chunk_id") == F.col("query_id")) & (F.col("rank") == 1)) == 1).alias("finds_itself"))


@query("SELECT count(*) AS queries, 4 AS bytes_per_vector, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def ret10_pq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-10: a search over codes of a byte per sixteen components, whose recall at 10 is measured here, against the exact
    search, on every stated query: whether it reaches 0.9."""
    v, q = fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    index = ann.build(v)
    exact = written(R.dense_batched(v, q, 10).select("query_id", "chunk_id", F.lit(1).alias("wanted")), "exact")
    rerank, _ = ann.calibrated_codes(spark, index, v, q, 10, len(index.centres), exact=exact.select("query_id", "chunk_id"))
    found = ann.search_coded(spark, index, q, 10, len(index.centres), rerank).select("query_id", "chunk_id")
    hit = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    sums = hit.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("wanted")).alias("reached"))
    return sums.select("queries", F.lit(len(index.books)).alias("bytes_per_vector"), "reached")


@query(f"{DENSE}) SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3")
def ret10_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-10: the three nearest of every stated query by codes of a byte per four components, re-ranked as deep as finds all
    that the exact search finds: how deep that is grows with the table, so it is measured and no constant."""
    v, q = fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    index = ann.build(v, sub_vectors=16)
    rerank, _ = ann.calibrated_codes(spark, index, v, q, 5, len(index.centres), least=1.0)
    found = ann.search_coded(spark, index, q, 5, len(index.centres), rerank).drop("rank")
    return R.top_k(found, 3, digits=9).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")
