"""Registered queries of parsing, chunking, embedding, text analytics, evaluation and streams."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import hashing as H
from folioforge.functions import text as X
from folioforge.operators import analytics as A, passages
from folioforge.operators import chunking, conversations, embedding, evaluation, parsing
from folioforge.operators import store as T
from folioforge.plans import fixtures as fx
from folioforge.plans.corpus_queries import tab
from folioforge.plans.registry import Registry
from folioforge.plans.scratch import new_dir
from folioforge.sources import filesystem as S
from folioforge.sources import snapshots
from folioforge.streaming import watch

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL


# --- sources ---


@query("SELECT page_id, CASE lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(\\.[^./\\\\]+)$', 1)) WHEN '.html' THEN 'text/html' WHEN '.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS media_type FROM pages")
def src02_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "pages").select("page_id", S.media_type(F.regexp_extract("url", r"^([^?#]*)", 1)).alias("media_type"))


@query("SELECT o_orderkey, concat_ws('+', strftime(o_orderdate, '%Y-%m-%d'), o_custkey, o_orderstatus) AS version_token FROM orders")
def src03_version_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "orders").select("o_orderkey", S.version_token(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey"), F.col("o_orderstatus")).alias("version_token"))


@query("WITH f AS (SELECT 'file' || event_id AS path, CASE WHEN event_id % 3 = 0 THEN 'id' || (event_id // 4) END AS declared_id FROM events) SELECT path, CASE WHEN declared_id IS NULL OR count(declared_id) OVER (PARTITION BY declared_id) > 1 THEN path ELSE declared_id END AS source_id, declared_id IS NOT NULL AND count(declared_id) OVER (PARTITION BY declared_id) > 1 AS conflict FROM f")
def src04_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return S.identities(tab(spark, sf_dir, "events").select(F.concat(F.lit("file"), e).alias("path"), F.when(e % 3 == 0, F.concat(F.lit("id"), F.floor(e / 4))).alias("declared_id")))


@query("WITH e AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS space, * FROM events), n AS (SELECT space, max(ts) AS w, bool_and(event_type <> 'error') AS ok FROM e GROUP BY 1), c AS (SELECT DISTINCT user_id || '/2024-01-03' AS space, TIMESTAMP '2024-01-03 12:00:00' AS position FROM events WHERE user_id % 3 = 0) SELECT coalesce(n.space, c.space) AS space, coalesce(CASE WHEN ok THEN greatest(w, coalesce(position, w)) END, position) AS position FROM n FULL JOIN c ON n.space = c.space")
def src08_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, STR-01: moved only by a complete enumeration, of each user's day."""
    e = tab(spark, sf_dir, "events")
    seen = e.select(F.concat_ws("/", "user_id", F.col("ts").cast("date")).alias("space"), F.col("ts").alias("when"), (F.col("event_type") != "error").alias("fine"))
    carried = e.where("user_id % 3 = 0").select(F.concat(F.col("user_id"), F.lit("/2024-01-03")).alias("space")).distinct().withColumn("position", F.lit("2024-01-03 12:00:00").cast("timestamp_ntz"))
    return S.watermarks(seen, carried, F.col("fine"))


@query("SELECT user_id, CASE WHEN user_id % 2 = 0 THEN max(ts) END AS position FROM events GROUP BY user_id")
def src09_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tab(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("position")).withColumn("scope", F.when(F.col("user_id") % 2 == 0, "s1").otherwise("s2"))
    return S.resumed(w, "s1").select("user_id", "position")


@query("WITH s AS (SELECT max(ts) - INTERVAL 3 DAY AS position FROM events) SELECT event_id FROM events, s WHERE ts >= date_trunc('minute', position - INTERVAL 30 MINUTE)")
def src10_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, STR-03."""
    e = tab(spark, sf_dir, "events")
    s = e.agg(F.max("ts").alias("m")).select(S.since(F.col("m") - F.expr("INTERVAL 3 DAYS"), 30).alias("since"))
    return e.crossJoin(F.broadcast(s)).where(F.col("ts") >= F.col("since")).select("event_id")


@query(r"SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) AS origin FROM pages")
def src12_same_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "pages").select("page_id", X.origin_of(F.col("url")).alias("origin"))


@query("WITH p AS (SELECT c_custkey AS page_id, list_value('n' || c_nationkey, 'r' || (c_nationkey % 5)) AS ancestors FROM customer) SELECT page_id, CASE WHEN list_contains(ancestors, 'n7') AND list_contains(ancestors, 'r2') THEN 'n7,r2' WHEN list_contains(ancestors, 'n7') THEN 'n7' ELSE 'r2' END AS roots FROM p WHERE list_contains(ancestors, 'n7') OR list_contains(ancestors, 'r2')")
def src13_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tab(spark, sf_dir, "customer")
    pages = c.select(F.col("c_custkey").cast("string").alias("page_id"), F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), F.col("c_nationkey") % 5)).alias("ancestors"))
    return S.covering_roots(pages, ["n7", "r2"]).select(F.col("page_id").cast("long").alias("page_id"), F.array_join("roots", ",").alias("roots"))


@query("WITH RECURSIVE e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents), r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON e.src = r.dst WHERE depth < 12) SELECT DISTINCT src, dst, src = dst AS cycle FROM r")
def src14_include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a page includes, to a depth of twelve: one join per level, over what is new."""
    e = tab(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst"))
    return T.include_closure(e, 12).select("src", "dst", "cycle")


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS titled, contains(html, '<article') AS adapted FROM pages")
def src17_saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: metadata and body of saved pages by profile."""
    out = snapshots.adapted(tab(spark, sf_dir, "pages"), (snapshots.Profile("wiki", "main"), snapshots.Profile("site", "article")))
    return out.select(F.col("id").alias("page_id"), (F.length(F.coalesce("title", F.lit(""))) > 0).alias("titled"), (F.col("outcome") == "adapted").alias("adapted"))


# --- parsing and chunking ---


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML and documents as plain text, as bytes."""
    p = tab(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("document_id"), F.encode("html", "UTF-8").alias("content"), F.lit("text/html").alias("media_type"))
    d = tab(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 9 == 0, "text/markdown").otherwise("text/plain").alias("media_type"))
    return fx.dealt(p).unionByName(fx.dealt(d))


@query()
def prs14_parse_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-01, PRS-02, PRS-03, PRS-14: all pages and documents through their parser chains."""
    return parsing.blocks(parsing.parsed(_raw(spark, sf_dir))).select("document_id", "position", "kind", "text", F.array_join("heading_path", " > ").alias("heading"), "anchor", "header_rows")


@query()
def prs16_anchor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line anchors read back hold what their block claims, after white space is made even."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def resolve(anchor, content):
        return anchor.combine(content, lambda a, c: parsing.resolved(a, bytes(c)))

    raw = _raw(spark, sf_dir).where("media_type = 'text/plain'")
    b = parsing.blocks(parsing.parsed(raw)).join(raw.select("document_id", "content"), "document_id")
    held = b.select("document_id", "position", "text", resolve("anchor", "content").alias("resolved"))
    return held.select("document_id", "position", F.contains(X.collapse(F.col("resolved")), X.collapse(F.col("text"))).alias("contained"), F.round(F.length("resolved") / F.greatest(F.length("text"), F.lit(1)), 3).alias("tightness"))


@query("SELECT n_nationkey AS document_id, path, text, refused FROM (SELECT n_nationkey, unnest(['a.txt', 'c.zip!deep.txt', '../b.txt']) AS path, unnest([n_name, n_name, '']) AS text, unnest([NULL, NULL, 'path']) AS refused FROM nation)")
def prs13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip of each nation's row, and a nested one; members become documents."""

    @F.pandas_udf("binary")
    def zipped(name):
        def one(n: str) -> bytes:
            inner, out = io.BytesIO(), io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr("deep.txt", n)
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("a.txt", n)
                z.writestr("../b.txt", n)
                z.writestr("c.zip", inner.getvalue())
            return out.getvalue()

        return name.map(one)

    a = tab(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document_id"), zipped("n_name").alias("content"))
    return parsing.expanded(a).select("document_id", "path", F.col("content").cast("string").alias("text"), "refused")


@query()
def chk03_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-02 to CHK-13 over all pages and documents."""
    p = parsing.parsed(_raw(spark, sf_dir)).where("status = 'parsed'").withColumn("title", F.col("document_id"))
    return chunking.chunked(p, chunking.Budget(256, 32, 32, 32)).select("document_id", "position", "kind", "token_count", "embed_text")


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda p: trim(p)), lambda p: p <> '')) AS n FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)) AS text FROM documents)")
def chk01_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "documents").select("doc_id", F.size(X.paragraphs(F.replace("text", F.lit(".\n"), F.lit(".\n \n")))).alias("n"))


@query(rf"WITH {fx.CHUNKS}, e AS (SELECT chunk_id, heading_text || chr(10) || chr(10) || text AS embed_text FROM chunks) SELECT chunk_id, len(regexp_extract_all(embed_text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS token_count, embed_text FROM e")
def chk11_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-10, CHK-11, CHK-13 for untruncated breadcrumbs: the tokens are those of the text that is embedded."""
    return chunking.with_breadcrumb(fx.chunks(spark, sf_dir)).select("chunk_id", "token_count", "embed_text")


@query(f"WITH {fx.CHUNKS}, k AS (SELECT document_id, CASE WHEN token_count > 50 THEN 'prose' ELSE 'list' END AS kind, sum(token_count) AS t, min(position) AS first FROM chunks GROUP BY ALL) SELECT document_id, arg_max(kind, t * 100000 - first) AS kind FROM k GROUP BY 1")
def chk12_dominant_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = fx.chunks(spark, sf_dir).withColumn("kind", F.when(F.col("token_count") > 50, "prose").otherwise("list"))
    return chunking.dominant_kind(units, ["document_id"])


@query(f"WITH {fx.CHUNKS} SELECT document_id, position // 4 AS part, min(position) AS start, max(position) AS end_, CASE WHEN count(DISTINCT left(text, 1)) = 1 THEN min(left(text, 1)) END AS symbol FROM chunks GROUP BY 1, 2")
def chk09_anchor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-09: line anchors of four units each as one, and the symbol that all share."""
    units = fx.chunks(spark, sf_dir).select("document_id", F.floor(F.col("position") / 4).alias("part"), F.col("position").alias("start"), F.col("position").alias("end"), F.substring("text", 1, 1).alias("symbol"))
    return chunking.merged_anchors(units, ["document_id", "part"], "symbol").withColumnRenamed("end", "end_")


# --- identity, scalar functions ---


@query("SELECT doc_id, left(sha256(lpad(hex(octet_length(encode(source))), 16, '0') || hex(encode(source)) || lpad(hex(octet_length(encode(text))), 16, '0') || hex(encode(text))), 32) AS id FROM documents")
def ids_plain_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity by length-prefixed parts, in the variant that SQL can check."""
    return tab(spark, sf_dir, "documents").select("doc_id", H.plain_digest(F.col("source"), F.col("text")).alias("id"))


@query()
def ids_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tab(spark, sf_dir, "documents")
    own = H.document_id(F.lit("w1"), F.col("source"), F.col("doc_id").cast("string"))
    c = d.select("doc_id", own.alias("document_id"), H.content_hash("text").alias("content_hash"), "text")
    c = c.withColumn("chunk_id", H.chunk_id("document_id", F.lit(0), "text"))
    return c.select("doc_id", "document_id", "content_hash", "chunk_id", H.vector_id(F.when(F.col("doc_id") % 2 == 0, "legacy").otherwise("p1"), F.col("chunk_id")).alias("vector_id"))


@query(r"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name || ' & ' || c_mktsegment)), '[^\p{L}\p{N}\s_-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer")
def scl_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "customer").select("c_custkey", X.slugify(F.concat_ws(" & ", "c_name", "c_mktsegment")).alias("slug"))


@query("WITH o AS (SELECT o_orderkey, o_orderkey % 9000 + 1 AS n FROM orders) SELECT o_orderkey, n, CASE WHEN n <= 26 THEN chr((64 + n)::INTEGER) WHEN n <= 702 THEN chr((65 + (n - 27) // 26)::INTEGER) || chr((65 + (n - 27) % 26)::INTEGER) ELSE chr((65 + (n - 703) // 676)::INTEGER) || chr((65 + ((n - 703) // 26) % 26)::INTEGER) || chr((65 + (n - 703) % 26)::INTEGER) END AS letters, n AS back FROM o")
def scl_a1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tab(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 9000 + 1).alias("n"))
    return n.withColumn("letters", X.column_letters(F.col("n"))).withColumn("back", X.column_index(F.col("letters")).cast("long"))


@query(r"WITH t AS (SELECT page_id, regexp_replace(html, '[^()\[\]{}]', '', 'g') AS b FROM pages) SELECT page_id, length(regexp_replace(b, '[^(]', '', 'g')) = length(regexp_replace(b, '[^)]', '', 'g')) AND length(regexp_replace(b, '[^{]', '', 'g')) = length(regexp_replace(b, '[^}]', '', 'g')) AS balanced FROM t")
def scl_brackets_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On these pages brackets of a kind that are as many also nest, which SQL can count."""
    return tab(spark, sf_dir, "pages").select("page_id", X.brackets_balance(F.col("html")).alias("balanced"))


@query(r"SELECT doc_id, upper(replace(array_to_string(list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w) NOT IN ('a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with')), lambda w: w[1]), ''), 'ß', 'SS')) AS initials FROM documents")
def scl_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "documents").select("doc_id", X.initials(F.col("text")).alias("initials"))


@query(r"SELECT page_id, regexp_replace(url, '\.[A-Za-z0-9]{1,5}$', '') AS title FROM pages")
def scl_strip_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "pages").select("page_id", X.strip_extension(F.col("url")).alias("title"))


# --- embedding ---


@query("SELECT vec_id AS chunk_id, round(sqrt(list_dot_product(u, u)), 6) AS norm FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(list_transform(embedding, lambda y: CAST(y AS DOUBLE)), list_transform(embedding, lambda y: CAST(y AS DOUBLE))))) AS u FROM embeddings)")
def emb02_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.operators.retrieval import norm, unit

    return fx.vectors(spark, sf_dir).select("chunk_id", F.round(norm(unit(F.col("vector"))), 6).alias("norm"))


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 10 = 0 THEN 'absent' WHEN vec_id % 10 = 1 THEN 'corrupt' WHEN vec_id % 10 = 2 THEN 'stale' ELSE 'readable' END AS state FROM embeddings")
def emb07_vector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("chunk_id") % 10
    v = fx.vectors(spark, sf_dir).select("chunk_id", F.when(k == 1, F.array(F.lit(1.0).cast("float"))).when(k != 0, F.col("vector")).alias("vector"), F.when(k == 2, "old").otherwise("now").alias("identity"))
    return embedding.classified(v, 64, F.lit("now"))


@query("SELECT CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 7 = 1 THEN 'mismatch' ELSE 'verified' END AS integrity, count(*) AS n FROM embeddings GROUP BY 1")
def emb09_checksum_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-08, EMB-09."""
    k = F.col("chunk_id") % 7
    v = fx.vectors(spark, sf_dir).select("chunk_id", "vector", F.when(k == 1, "bad").when(k != 0, H.checksum("vector")).alias("checksum"))
    return embedding.integrity(v).groupBy("integrity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.CHUNKS}, c AS (SELECT chunk_id, document_id % 6 AS k FROM chunks) SELECT CASE WHEN k = 0 THEN 'first_seen' WHEN k = 1 THEN 'input_changed' ELSE 'reused' END AS origin, count(*) AS n FROM c GROUP BY 1")
def emb06_embed_or_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-04, EMB-06, JOI-17: what is stored is taken, what isn't is embedded once per text."""
    c = fx.chunks(spark, sf_dir)
    mine = c.select("chunk_id", F.concat_ws("|", "chunk_id", F.md5("text")).alias("identity"), F.col("text").alias("embed_text"))
    k = F.col("document_id") % 6
    stored = c.where(k != 0).select("chunk_id", F.when(k == 1, "other").otherwise(F.concat_ws("|", "chunk_id", F.md5("text"))).alias("identity"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    return embedding.embed_or_reuse(mine, stored, embedding.hashing_embedder(16)).where("vector is not null").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


# --- text analytics ---


def _defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a definition: the segment's words, its initials in brackets."""
    c = tab(spark, sf_dir, "customer")
    head = F.when(F.col("c_custkey") % 3 == 0, "Glossary").otherwise("Notes")
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("the National "), F.initcap("c_mktsegment"), F.lit(" Office (N"), F.substring("c_mktsegment", 1, 1), F.lit("O) is open"))).otherwise(F.concat(F.lit("N"), F.substring("c_mktsegment", 1, 1), F.lit("O: National "), F.initcap("c_mktsegment"), F.lit(" Office")))
    return c.select(F.col("c_custkey").cast("string").alias("chunk_id"), body.alias("text"), head.alias("heading_text"))


@query("SELECT c_custkey::VARCHAR AS chunk_id, 'N' || c_mktsegment[1] || 'O' AS acronym, 'National ' || c_mktsegment[1] || lower(c_mktsegment[2:]) || ' Office' AS expansion, CASE WHEN c_custkey % 2 = 0 THEN 'parenthetical' ELSE 'colon' END AS form, CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.8 END + CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 0.1 ELSE 0.15 END ELSE 0 END AS confidence FROM customer")
def glo01_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GLO-01 to GLO-04."""
    return A.glossary(_defined(spark, sf_dir)).select("chunk_id", "acronym", "expansion", "form", F.round("confidence", 4).alias("confidence"))


@query("SELECT 'N' || c_mktsegment[1] || 'O' AS acronym, count(DISTINCT c_mktsegment) AS n_expansions, count(DISTINCT c_mktsegment) > 1 AS conflict FROM customer GROUP BY 1")
def ret21_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conflicts(A.glossary(_defined(spark, sf_dir))).select("acronym", "n_expansions", "conflict")


@query("SELECT c_custkey AS query_id, 'N' || c_mktsegment[1] || 'O' AS key, CASE WHEN c_custkey % 3 = 0 THEN 'exact_case' WHEN c_custkey % 3 = 1 THEN 'definitional_frame' ELSE 'unambiguous' END AS reason, replace(CASE WHEN c_custkey % 3 = 0 THEN 'is the NXO open' WHEN c_custkey % 3 = 1 THEN 'what is the nxo' ELSE 'hours nxo' END, CASE WHEN c_custkey % 3 = 0 THEN 'NXO' ELSE 'nxo' END, 'National Office') AS rewritten FROM customer")
def ret20_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-19, RET-20, RET-22: surfaces, why they fire, the query rewritten."""
    k, own = F.col("c_custkey"), F.concat(F.lit("N"), F.substring("c_mktsegment", 1, 1), F.lit("O"))
    q = tab(spark, sf_dir, "customer").select(k.alias("query_id"), F.when(k % 3 == 0, F.concat(F.lit("is the "), own, F.lit(" open"))).when(k % 3 == 1, F.concat(F.lit("what is the "), F.lower(own))).otherwise(F.concat(F.lit("hours "), F.lower(own))).alias("text"), own.alias("own"))
    s = A.surfaces(q).join(q, "query_id").where("key = own")
    why = A.fires(F.col("surface"), F.col("key"), F.col("text"), ("the", "is", "what"))
    return s.select("query_id", "key", why.alias("reason"), A.rewritten(F.col("text"), F.col("surface"), F.lit("National Office")).alias("rewritten"))


@query("WITH e AS (SELECT c_custkey AS entry_id, 'N' || c_mktsegment[1] || 'O' AS acronym, c_custkey % 1000 AS document_id FROM customer), a AS (SELECT c_custkey AS entry_id, 'ALT' || (c_custkey % 10) AS key FROM customer WHERE c_custkey % 5 = 0), q(query_id, key) AS (VALUES (1, 'NBO'), (1, 'ALT5'), (2, 'ALT0'), (3, 'NONE')), n AS (SELECT entry_id, acronym AS key FROM e UNION SELECT * FROM a) SELECT DISTINCT q.query_id, e.entry_id, e.acronym FROM q JOIN n USING (key) JOIN e USING (entry_id) JOIN documents d ON d.doc_id = e.document_id WHERE d.lang = 'en'")
def ret18_glossary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-18, JOI-03."""
    k = F.col("c_custkey")
    c = tab(spark, sf_dir, "customer")
    e = c.select(k.alias("entry_id"), F.concat(F.lit("N"), F.substring("c_mktsegment", 1, 1), F.lit("O")).alias("acronym"), (k % 1000).alias("document_id"), F.lit("x").alias("expansion"), F.lit(0.9).alias("confidence"))
    a = c.where("c_custkey % 5 = 0").select(k.alias("entry_id"), F.concat(F.lit("ALT"), k % 10).alias("key"))
    q = spark.createDataFrame([(1, "NBO"), (1, "ALT5"), (2, "ALT0"), (3, "NONE")], "query_id int, key string")
    d = tab(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("document_id"))
    return A.lookups(e, a, q, d).select("query_id", "entry_id", "acronym")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email, len(regexp_extract_all(text, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b')) AS n_ip FROM documents")
def red01_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.mention_counts(F.col("text"))
    return tab(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in counts.items()])


@query()
def red01_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors with arbitration of overlaps, over all documents."""
    out = A.redacted(tab(spark, sf_dir, "documents"), "doc_id", "text", "hash", b"key")
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("counts")))).alias("counts"))


ANSWERS = "answers AS (SELECT conv_id * 100 + turn AS answer_id, text || ' [[cite:' || (turn % 3) || ',' || (conv_id % 5) || ']] and [[cite:' || (turn % 3) || ']] [[cite:x]]' AS text, turn % 3 AS s1, conv_id % 5 AS s2 FROM conversations WHERE role = 'assistant')"


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = tab(spark, sf_dir, "conversations").where("role = 'assistant'")
    a = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.concat("text", F.lit(" [[cite:"), F.col("turn") % 3, F.lit(","), F.col("conv_id") % 5, F.lit("]] and [[cite:"), F.col("turn") % 3, F.lit("]] [[cite:x]]")).alias("text"))
    p = a.select("answer_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("slot")).withColumn("chunk_id", F.concat(F.lit("c"), F.floor(F.col("slot") / 2)))
    return a, p


@query(f"WITH {ANSWERS}, slots AS (SELECT answer_id, s1 AS slot, 0 AS pos FROM answers UNION ALL SELECT answer_id, s2, 1 FROM answers WHERE s1 <> s2), b AS (SELECT *, CASE WHEN slot <= 2 THEN 'c' || (slot // 2) END AS chunk_id FROM slots) SELECT answer_id, slot::INTEGER AS slot, chunk_id, CASE WHEN chunk_id IS NULL THEN 'unknown_slot' WHEN row_number() OVER (PARTITION BY answer_id, chunk_id ORDER BY pos) > 1 THEN 'repeated' ELSE 'bound' END AS outcome FROM b")
def cit02_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIT-01, CIT-02."""
    return A.bound(*_answers(spark, sf_dir))


@query(f"WITH {ANSWERS} SELECT answer_id, 1 AS malformed FROM answers")
def cit01_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _answers(spark, sf_dir)
    return a.select("answer_id", A.malformed(F.col("text")).alias("malformed"))


@query(f"WITH {ANSWERS} SELECT answer_id, 1 + CASE WHEN s2 <= 2 AND s2 // 2 <> s1 // 2 THEN 1 ELSE 0 END AS n_bound, CASE WHEN s1 = s2 THEN 0 WHEN s2 > 2 OR s2 // 2 = s1 // 2 THEN 1 ELSE 0 END AS n_dropped, false AS ungrounded FROM answers")
def cit02_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = _answers(spark, sf_dir)
    return A.accounted(A.bound(a, p), a)


# --- evaluation ---


@query("WITH b AS (SELECT item_id, count(d.doc_id) AS n FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1) SELECT item_id, n > 0 AS found, n::BIGINT AS n_documents FROM b")
def eva01_known_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that occur verbatim, found by anchors that they share with texts."""
    b = tab(spark, sf_dir, "benchmark")
    hits = passages.occurrences(tab(spark, sf_dir, "documents"), b, "doc_id", "text", "item_id", "text").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return b.select("item_id").join(hits, "item_id", "left").select("item_id", (n > 0).alias("found"), n.alias("n_documents"))


@query("""WITH lines AS (SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(line) > 0)
SELECT line, count(*) AS n_documents FROM lines JOIN documents d ON contains(d.text, line) GROUP BY 1""")
def eva01_passage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-01: every line of every passage, of whatever length, in all documents."""
    lines = tab(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 0").distinct()
    asked = lines.select("line", F.col("line").alias("key"))
    return passages.occurrences(tab(spark, sf_dir, "documents"), asked, "doc_id", "text", "key", "line").groupBy(F.col("key").alias("line")).agg(F.count(F.lit(1)).alias("n_documents"))


RANKED = f"{fx.COSINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cosines)"


@query(f"WITH {RANKED}, answers AS (SELECT query_id, arg_max(chunk_id, score) AS chunk_id FROM cosines WHERE chunk_id <> query_id GROUP BY 1) SELECT query_id, rank <= 5 AS hit FROM answers JOIN ranked USING (query_id, chunk_id)")
def eva01_probe_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-01: the known answer of each probe is the nearest other vector; is it among the five first?"""
    from folioforge.operators.retrieval import dense_batched

    v, q = fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    near = dense_batched(v, q, 2).where("chunk_id <> query_id")
    answers = near.groupBy("query_id").agg(F.min_by("chunk_id", F.struct("rank")).alias("chunk_id"))
    return evaluation.probe_hits(dense_batched(v, q, 5), answers, 5).select("query_id", "hit")


#: The binomial tail, summed in logarithms, that chance finds as many of n answers among five of all rows.
TAIL = "(SELECT least(1, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(c) + (n - i) * ln(1 - c)))) FROM range(hits, n + 1) t(i))"


@query(f"WITH {RANKED}, h AS (SELECT count(*) AS n, count(*) FILTER (rank <= 5) AS hits, 5.0::DOUBLE / (SELECT count(*) FROM embeddings) AS c FROM ranked WHERE chunk_id = query_id), p AS (SELECT *, {TAIL} AS p FROM h) SELECT n, hits, round(p, 9) AS p, CASE WHEN pow(c, n) > 0.01 THEN 'underpowered' WHEN p < 0.01 THEN 'passed' ELSE 'failed' END AS outcome FROM p")
def eva01_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query vector must find itself: hits, chance and the binomial tail."""
    from folioforge.operators.retrieval import dense_batched

    v, q = fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    answers = q.select("query_id", F.col("query_id").alias("chunk_id"))
    return evaluation.probe(dense_batched(v, q, 5), answers, v.count()).select("n", "hits", F.round("p", 9).alias("p"), "outcome")


@query(r"WITH t AS (SELECT regexp_replace(url, '\.[A-Za-z0-9]{1,5}$', '') AS title, page_id FROM pages) SELECT title, min(page_id) AS page_id FROM t WHERE length(title) >= 3 GROUP BY title HAVING count(*) = 1 ORDER BY title LIMIT 100")
def eva02_probe_from_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tab(spark, sf_dir, "pages").select(X.strip_extension(F.col("url")).alias("title"), "page_id")
    return evaluation.probes_from_titles(t, "page_id", 100)


@query("""WITH o AS (SELECT d.lang AS intent, CASE WHEN quality = 1 AND toxic = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'right' ELSE 'left' END WHEN quality = 1 THEN 'tie' ELSE 'neither' END AS outcome FROM labels JOIN documents d USING (doc_id)),
s AS (SELECT coalesce(intent, 'overall') AS intent, count(*) FILTER (outcome = 'left') AS l, count(*) FILTER (outcome = 'right') AS r, count(*) FILTER (outcome = 'tie') AS tie, count(*) FILTER (outcome = 'neither') AS neither FROM o GROUP BY ROLLUP (intent))
SELECT intent, l AS "left", r AS "right", tie, neither, round(l / (l + r), 6) AS share, round(greatest((l / (l + r) + 3.841458820694124 / (2 * (l + r))) / (1 + 3.841458820694124 / (l + r)) - 1.959963984540054 * sqrt(l / (l + r) * (1 - l / (l + r)) / (l + r) + 3.841458820694124 / (4.0 * (l + r) * (l + r))) / (1 + 3.841458820694124 / (l + r)), 0), 6) AS low,
round(least((l / (l + r) + 3.841458820694124 / (2 * (l + r))) / (1 + 3.841458820694124 / (l + r)) + 1.959963984540054 * sqrt(l / (l + r) * (1 - l / (l + r)) / (l + r) + 3.841458820694124 / (4.0 * (l + r) * (l + r))) / (1 + 3.841458820694124 / (l + r)), 1), 6) AS high FROM s""")
def eva05_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-05, AGG-14: by intent and overall in one rollup."""
    j = tab(spark, sf_dir, "labels").join(tab(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("intent")), "doc_id")
    outcome = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.when(F.col("doc_id") % 5 == 0, "right").otherwise("left")).when(F.col("quality") == 1, "tie").otherwise("neither")
    r = evaluation.report(j.select("intent", outcome.alias("outcome")))
    return r.select("intent", "left", "right", "tie", "neither", *[F.round(c, 6).alias(c) for c in ("share", "low", "high")])


@query("""WITH o AS (SELECT d.lang AS intent, CASE WHEN quality = 1 AND toxic = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'right' ELSE 'left' END END AS outcome FROM labels JOIN documents d USING (doc_id)),
s AS (SELECT coalesce(intent, 'overall') AS intent, count(*) FILTER (outcome = 'left') AS l, count(*) FILTER (outcome = 'right') AS r FROM o GROUP BY ROLLUP (intent))
SELECT intent, round(least(1, 2 * (SELECT sum(exp(lgamma(l + r + 1) - lgamma(i + 1) - lgamma(l + r - i + 1) - (l + r) * ln(2))) FROM range(CAST(least(l, r) + 1 AS BIGINT)) t(i))), 6) AS p, 6 AS needs FROM s""")
def eva05_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = eva05_report(spark, sf_dir)
    return r.select("intent", F.round(evaluation.sign_test_p("left", "right"), 6).alias("p"), F.lit(evaluation.smallest_detectable()).alias("needs"))


@query()
def eva03_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "benchmark").select("item_id", evaluation.slot(F.lit("seed"), F.col("item_id").cast("string")).alias("slot"))


@query("SELECT vec_id AS query_id, 1 AS left_rank, CASE WHEN vec_id % 4 <> 0 THEN 1 END AS right_rank, vec_id % 100 = 0 AS same FROM embeddings WHERE vec_id % 50 = 0")
def eva04_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-04, JOI-18: two systems paired by query, with a guard against drifted settings."""
    from folioforge.operators.retrieval import dense_batched

    v, q = fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    wanted = q.select("query_id", F.col("query_id").alias("chunk_id"))
    left = dense_batched(v, q, 3).withColumn("config", F.lit("a"))
    right = dense_batched(v.where("chunk_id % 4 <> 0"), q, 3).withColumn("config", F.when(F.col("query_id") % 100 == 0, "a").otherwise("b"))
    return evaluation.paired(left, right, wanted)


@query("WITH g AS (SELECT left(md5(doc_id::VARCHAR), 1) AS part, sha256(string_agg(doc_id || chr(0) || md5(text) || chr(10), '' ORDER BY doc_id || chr(0) || md5(text) || chr(10))) AS d FROM documents GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY part)) AS digest, count(*) AS groups FROM g")
def eva06_corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tab(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("content_hash"))
    return evaluation.corpus_digest(d)


SIDES = """l AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 97 <> 5), r AS (SELECT doc_id, CASE WHEN doc_id % 89 = 7 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 83 <> 11)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents twice: some are missing on either side and some changed on the right."""
    d, i = tab(spark, sf_dir, "documents"), F.col("doc_id")
    right = F.when(i % 89 == 7, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    return d.where("doc_id % 97 <> 5").select(i.alias("document_id"), F.md5("text").alias("content_hash")), d.where("doc_id % 83 <> 11").select(i.alias("document_id"), right.alias("content_hash"))


@query(f"WITH {SIDES} SELECT coalesce(l.doc_id, r.doc_id) AS document_id, CASE WHEN r.h IS NULL THEN 'missing' WHEN l.h IS NULL THEN 'new' ELSE 'changed' END AS state FROM l FULL JOIN r ON l.doc_id = r.doc_id WHERE l.h IS DISTINCT FROM r.h")
def eva06_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-06, SNK-04: rows that two corpora don't share, by trees of digests of which only unequal nodes are descended."""
    return evaluation.disagreement(*_sides(spark, sf_dir), digits=2)


@query("""WITH a AS (SELECT md5(doc_id::VARCHAR) AS k, doc_id || chr(0) || md5(text) || chr(10) AS line FROM documents), l2 AS (SELECT left(k, 2) AS prefix, sha256(string_agg(line, '' ORDER BY line)) AS digest, count(*) AS n FROM a GROUP BY 1),
l1 AS (SELECT left(prefix, 1) AS prefix, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest, sum(n)::BIGINT AS n FROM l2 GROUP BY 1), l0 AS (SELECT '' AS prefix, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest, sum(n)::BIGINT AS n FROM l1)
SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0""")
def eva06_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-06: the tree of a corpus's digests, two digits deep."""
    d = tab(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("content_hash"))
    return evaluation.merkle_tree(d, 2)


# --- streams ---


@query("WITH l AS (SELECT user_id AS path, arg_max(event_type, event_id) AS change, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1) SELECT path, change, first, last, row_number() OVER (ORDER BY first, path)::INTEGER AS place FROM l")
def str04_coalesced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tab(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("change"), F.col("event_id").alias("seq"))
    return watch.coalesced(e).withColumn("place", F.col("place").cast("int"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def str02_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the events, published by batch, read back as the latest row per key."""
    schema = tab(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at, checkpoint = new_dir(spark, "upserts"), new_dir(spark, "stream")
    watch.published(stream.select("user_id", "event_type", "event_id"), watch.upsert_into(at, ["user_id"], "event_id"), checkpoint).awaitTermination()
    return watch.upserted(spark, at, ["user_id"], "event_id")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def str03_stream_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows within the delay are kept once per version."""
    schema = tab(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("ts").cast("timestamp").alias("when"), F.col("user_id").alias("source_id"), F.col("event_id").alias("version_token"))
    at, checkpoint = new_dir(spark, "reread"), new_dir(spark, "stream")
    watch.reread_stream(rows, "30 days").writeStream.format("parquet").option("path", at).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("users"))


@query("SELECT 'set-' || (item_id % 3) AS name, item_id::VARCHAR AS id, text, item_id % 2 = 0 AS thumbs FROM benchmark")
def snk05_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, SNK-06, SRC-20, SRC-21: query sets written as JSON lines, read with their schema, refused if malformed."""
    at = new_dir(spark, "export")
    b = tab(spark, sf_dir, "benchmark")
    sets = b.select(F.lit(1).alias("schema_version"), F.concat(F.lit("set-"), F.col("item_id") % 3).alias("name"), F.struct(F.col("item_id").cast("string").alias("id"), F.col("text"), F.lit("find").alias("intent"), (F.col("item_id") % 2 == 0).alias("thumbs")).alias("query"))
    T.exported(sets.groupBy("schema_version", "name").agg(F.collect_list("query").alias("queries")), at)
    read = T.imported(spark, at, "schema_version INT, name STRING, queries ARRAY<STRUCT<id: STRING, text: STRING, intent: STRING, thumbs: BOOLEAN>>")
    return read.select("name", F.explode("queries").alias("q")).select("name", "q.id", "q.text", "q.thumbs")


@query("WITH l AS (SELECT page_id, sha256(html) AS sha256 FROM pages WHERE page_id % 5 <> 0), n AS (SELECT page_id, page_id % 7 = 2 AS moved FROM pages WHERE page_id % 9 <> 1) SELECT coalesce(l.page_id, n.page_id) AS page_id, sha256, CASE WHEN l.page_id IS NULL THEN 'new' WHEN n.page_id IS NULL THEN 'missing' WHEN moved THEN 'changed' ELSE 'same' END AS state FROM l FULL JOIN n ON l.page_id = n.page_id")
def snk04_backup_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory of digests against pages of which some changed, are missing or new."""
    p, i = tab(spark, sf_dir, "pages").select("page_id", "html"), F.col("page_id")
    now = p.where("page_id % 9 <> 1").select(i, F.when(i % 7 == 2, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("html"))
    return T.backup_states(T.inventory(p.where("page_id % 5 <> 0"), "page_id", "html"), T.inventory(now, "page_id", "html"), "page_id")


@query("SELECT md5(text) AS blob, min(doc_id) AS first, count(*) AS n, min(length(text)) AS size, CASE WHEN min(strlen(text)) > 20000 THEN 'too_large' END AS omitted, max(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) = 1 AS compressed FROM documents GROUP BY 1")
def snk03_blob_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed: one blob per content, too large ones known but not kept."""
    d = tab(spark, sf_dir, "documents").withColumn("media_type", F.when(F.col("doc_id") % 2 == 0, "text/plain").otherwise("image/png"))
    return T.blobs(d, "text", "doc_id", 20_000, "media_type").select("blob", "first", "n", "size", "omitted", "compressed")


@query(f"WITH {ANSWERS}, s AS (SELECT answer_id, s1 AS slot FROM answers UNION ALL SELECT answer_id, s2 FROM answers WHERE s2 <= 2 AND s2 // 2 <> s1 // 2) SELECT answer_id, slot::INTEGER AS slot, slot::INTEGER + 1 AS page, CASE WHEN slot <> 1 THEN 'chapter ' || slot END AS trail FROM s")
def cnv02_anonymous_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNV-02: what an anonymous reader sees of each citation."""
    a, p = _answers(spark, sf_dir)
    kinds = F.when(F.col("slot") == 0, "page").when(F.col("slot") == 1, "mail").otherwise("manual")
    cited = A.bound(a, p).where("outcome = 'bound'").select("answer_id", "slot", (F.col("slot") + 1).alias("page"), kinds.alias("kind"), F.concat(F.lit("chapter "), "slot").alias("heading_text"), F.lit("secret title").alias("title"))
    return conversations.anonymous(cited)


@query("WITH l AS (SELECT page_id, html FROM pages WHERE page_id % 5 <> 0), n AS (SELECT page_id, CASE WHEN page_id % 7 = 2 THEN html || '!' ELSE html END AS html FROM pages WHERE page_id % 9 <> 1) SELECT coalesce(l.page_id, n.page_id) AS page_id, md5(coalesce(l.html, n.html)) AS content FROM l FULL JOIN n ON l.page_id = n.page_id")
def snk04_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: what changed or went missing is taken from the backup, what is new stays."""
    p, i = tab(spark, sf_dir, "pages").select("page_id", "html"), F.col("page_id")
    now = p.where("page_id % 9 <> 1").select(i, F.when(i % 7 == 2, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("html"))
    return T.restored(p.where("page_id % 5 <> 0"), now, "page_id", "html").select("page_id", F.md5("html").alias("content"))
