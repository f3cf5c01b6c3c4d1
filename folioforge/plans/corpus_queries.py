"""Registered queries of corpus management, each beside its SQL.

Runs, records and blobs of the store are read from ``orders``, ``lineitem`` and ``part``;
paths and connectors from the ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators import chunking, conversations, embedding
from folioforge.operators import corpus as C
from folioforge.operators import lifecycle as L
from folioforge.operators import store as T
from folioforge.plans import fixtures as fx
from folioforge.plans.registry import Registry

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
D = fx.DOCUMENTS


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.documents(spark, sf_dir)


def tab(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fx.table(spark, sf_dir, name)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition runs: the orders."""
    return tab(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("scope"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("priority"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their records: the line items, each with its blob (the part) and its bytes (the quantity)."""
    return tab(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("blob"), F.col("l_suppkey").alias("source_id"), F.col("l_quantity").alias("bytes"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"), F.col("l_discount").alias("share"))


# --- filters ---


@query(f"WITH {D} SELECT document_id, updated_s FROM docs WHERE NOT deleted AND source IN ('src1', 'src2') AND lang IN ('en') AND updated_s > 600 ORDER BY updated_s DESC, document_id LIMIT 50 OFFSET 10")
def flt01_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, SRT-01."""
    return C.listed(docs(spark, sf_dir), C.Filter(sources=("src1", "src2"), langs=("en",), updated_after=600), 50, 10).select("document_id", "updated_s")


@query(f"WITH {fx.CHUNKS}, {D} SELECT c.chunk_id FROM chunks c JOIN docs d USING (document_id) WHERE d.status = 'indexed' AND NOT d.deleted AND d.lang IN ('fr', 'de') AND d.source IN ('src3')")
def flt02_lexical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = docs(spark, sf_dir).where("status = 'indexed' and not deleted").where(C.Filter(langs=("fr", "de"), sources=("src3",)).predicate())
    return fx.chunks(spark, sf_dir).join(kept.select("document_id"), "document_id", "left_semi").select("chunk_id")


@query("SELECT vec_id AS document_id, label FROM embeddings WHERE vec_id IN (1, 5, 7, 11)")
def flt03_vector_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.vectors(spark, sf_dir).withColumnRenamed("chunk_id", "document_id")
    return v.where(C.Filter(document_ids=(1, 5, 7, 11)).predicate(C.VECTOR_FIELDS)).select("document_id", "label")


@query(f"WITH {D}, c AS (SELECT least(count(*), 101) AS n FROM docs WHERE NOT deleted AND lang = 'fr') SELECT CASE WHEN n = 0 THEN 'empty' WHEN n <= 100 THEN 'prefilter' ELSE 'postfilter' END AS regime, n FROM c")
def flt04_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, SRT-03."""
    return C.regime(docs(spark, sf_dir), C.Filter(langs=("fr",)), True, 100)


MANUAL = "manual AS (SELECT 'c' || (doc_id % 5) AS collection_id, doc_id AS document_id FROM documents WHERE doc_id % 3 = 0)"
RULED = f"ruled AS (SELECT 'c1' AS collection_id, document_id FROM docs WHERE lang = 'es' UNION ALL SELECT 'c2', document_id FROM docs WHERE source IN ('src4', 'src5') AND updated_s < 30000)"
TAGGED = "tagged AS (SELECT doc_id AS document_id, 't' || (doc_id % k) AS tag FROM documents, (VALUES (2), (3), (4)) AS m(k))"


def manual_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("c"), F.col("doc_id") % 5).alias("collection_id"), F.col("doc_id").alias("document_id"))


def ruled_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    one = d.where(C.Filter(langs=("es",)).predicate()).select(F.lit("c1").alias("collection_id"), "document_id")
    return one.union(d.where(C.Filter(sources=("src4", "src5"), updated_before=30000).predicate()).select(F.lit("c2").alias("collection_id"), "document_id"))


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tab(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    return d.select("document_id", F.explode(F.array(*[F.concat(F.lit("t"), F.col("document_id") % k) for k in (2, 3, 4)])).alias("tag"))


@query(f"WITH {D}, {MANUAL}, {RULED} SELECT DISTINCT collection_id, document_id FROM (SELECT * FROM manual UNION ALL SELECT * FROM ruled)")
def flt07_collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06, FLT-07, ORG-02."""
    return C.members(manual_members(spark, sf_dir), ruled_members(spark, sf_dir))


@query(f"WITH {D}, {MANUAL}, {RULED}, {TAGGED}, m AS (SELECT * FROM manual UNION SELECT * FROM ruled) SELECT document_id FROM m WHERE collection_id IN ('c1', 'c2') INTERSECT SELECT document_id FROM tagged WHERE tag IN ('t1')")
def flt05_membership_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, SET-04, JOI-05: OR in a dimension, AND across."""
    m = C.members(manual_members(spark, sf_dir), ruled_members(spark, sf_dir)).where("collection_id in ('c1', 'c2')")
    return C.scoped([m, tagged_documents(spark, sf_dir).where("tag in ('t1')")])


@query(f"WITH {TAGGED} SELECT document_id FROM tagged WHERE tag IN ('t1', 't2', 't3') GROUP BY document_id HAVING count(DISTINCT tag) = 3")
def agg04_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, ORG-03."""
    return C.in_all(tagged_documents(spark, sf_dir), "tag", ("t1", "t2", "t3"))


FPS = "fps AS (SELECT doc_id AS document_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'p1' WHEN 2 THEN 'p2' ELSE 'p0' END AS parse_fp, CASE doc_id % 3 WHEN 0 THEN 'c2' WHEN 1 THEN 'c1' END AS chunk_fp FROM documents)"


def _fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    parse = F.when(i % 4 == 1, "p1").when(i % 4 == 2, "p2").when(i % 4 == 3, "p0")
    return tab(spark, sf_dir, "documents").select(i.alias("document_id"), parse.alias("parse_fp"), F.when(i % 3 == 0, "c2").when(i % 3 == 1, "c1").alias("chunk_fp"))


@query(f"WITH {FPS} SELECT document_id FROM fps WHERE parse_fp IS NULL OR parse_fp NOT IN ('p1', 'p2') OR chunk_fp IS NULL OR chunk_fp <> 'c2'")
def flt09_stale_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09, LIF-12."""
    return C.stale(_fps(spark, sf_dir), {"parse_fp": ("p1", "p2"), "chunk_fp": ("c2",)}).select("document_id")


FOUND = "found AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'v' || (doc_id % 6) END AS token, md5(CASE WHEN doc_id % 8 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 0)"
HAVE = "have AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'v' || (doc_id % 3) END AS token, md5(text) AS content_hash FROM documents WHERE doc_id % 13 <> 0)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = tab(spark, sf_dir, "documents").where("doc_id % 11 <> 0"), F.col("doc_id")
    return d.select(i.alias("document_id"), F.when(i % 10 != 0, F.concat(F.lit("v"), i % 6)).alias("token"), F.md5(F.when(i % 8 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))


def _have(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = tab(spark, sf_dir, "documents").where("doc_id % 13 <> 0"), F.col("doc_id")
    return d.select(i.alias("document_id"), F.when(i % 10 != 0, F.concat(F.lit("v"), i % 3)).alias("token"), F.md5("text").alias("content_hash"))


@query(f"""WITH {FOUND}, {HAVE} SELECT coalesce(h.document_id, f.document_id) AS document_id, CASE WHEN h.document_id IS NULL THEN 'new' WHEN f.document_id IS NULL THEN 'gone'
 ELSE concat_ws('+', CASE WHEN h.content_hash IS DISTINCT FROM f.content_hash THEN 'content' END, CASE WHEN h.token IS DISTINCT FROM f.token THEN 'metadata' END) END AS changed FROM have h FULL JOIN found f ON h.document_id = f.document_id""")
def flt11_change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, FLT-11, JOI-26: null-safe comparison of two levels."""
    return C.change_kinds(_have(spark, sf_dir), _found(spark, sf_dir), {"content": ["content_hash"], "metadata": ["token"]})


@query(f"WITH {D}, {fx.CHUNKS} SELECT c.chunk_id, c.token_count FROM chunks c JOIN docs d USING (document_id) WHERE d.source NOT IN ('src7', 'src8')")
def flt13_egress_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of local sources, and of unknown documents, don't leave."""
    return T.outbound(fx.chunks(spark, sf_dir), docs(spark, sf_dir), ("src7", "src8")).select("chunk_id", "token_count")


@query(r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^.*\.html$') AND NOT regexp_matches(url, '^https?://m\..*$')")
def flt14_ignore_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.sources.filesystem import ignored

    return tab(spark, sf_dir, "pages").where(~ignored(F.col("url"), ("*.html", "http://m.*", "https://m.*"))).select("page_id", "url")


# --- projections ---


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def prj02_json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "events").select("event_id", T.json_field("props", "$.k", "long").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'OMITTED' ELSE o_orderstatus END AS state FROM orders")
def prj03_state_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "orders").select("o_orderkey", L.public_state(F.col("o_orderstatus"), {"P": "OMITTED"}).alias("state"))


# --- joins ---


@query(f"WITH {fx.CHUNKS}, {D} SELECT d.source, count(*) AS n_chunks, sum(c.token_count)::BIGINT AS tokens FROM chunks c JOIN docs d USING (document_id) WHERE d.status = 'indexed' GROUP BY d.source")
def joi01_chunks_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-01, AGG-03."""
    return T.chunk_totals(fx.chunks(spark, sf_dir), docs(spark, sf_dir).where("status = 'indexed'"))


@query(f"WITH {D}, {MANUAL}, {TAGGED} SELECT m.collection_id, t.tag, count(*) AS n FROM manual m JOIN tagged t USING (document_id) GROUP BY ALL")
def joi04_collections_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.both_counts(manual_members(spark, sf_dir), tagged_documents(spark, sf_dir), "document_id", ["collection_id", "tag"])


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def joi06_not_in_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _records(spark, sf_dir).where("flag = 'R'")
    return L.not_in_inventory(_runs(spark, sf_dir), seen, "run_id").select(F.col("run_id").alias("o_orderkey"))


@query("SELECT p_partkey AS blob FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity < 10)")
def joi07_unreferenced_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-07, SET-01, DML-07."""
    li = tab(spark, sf_dir, "lineitem")
    refs = [li.where("l_quantity > 45").select(F.col("l_partkey").alias("blob")), li.where("l_quantity < 10").select(F.col("l_suppkey").cast("long").alias("blob"))]
    return C.unreferenced(tab(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob")), refs)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 30) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def joi08_history_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that neither an open record nor a customer's marker holds."""
    runs = _runs(spark, sf_dir).where("state <> 'O'")
    holds = [(_records(spark, sf_dir).where("state = 'O' and bytes > 30"), "run_id"), (tab(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("scope")), "scope")]
    return L.releasable(runs, holds).select(F.col("run_id").alias("o_orderkey"))


DEPS = "deps AS (SELECT doc_id AS parent, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS target FROM documents)"


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tab(spark, sf_dir, "documents")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select(  # one row
        F.col("doc_id").alias("parent"), ((F.col("doc_id") * 7 + 3) % F.col("n")).alias("target")
    )


@query(f"WITH {D}, {DEPS} SELECT d.parent, d.target FROM deps d JOIN docs p ON p.document_id = d.parent JOIN docs t ON t.document_id = d.target WHERE NOT p.deleted AND t.deleted")
def joi10_deleted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-09, JOI-10, LIF-16: parents to fetch again when what they include changes."""
    d = docs(spark, sf_dir).select("document_id", "deleted")
    return L.refetch_parents(_deps(spark, sf_dir), d, d.where("deleted"))


@query("SELECT o.o_orderstatus AS state, count(DISTINCT p.p_partkey) AS blobs, count(*) AS records FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1")
def joi11_records_runs_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = tab(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob"))
    return L.run_blob_counts(_records(spark, sf_dir), _runs(spark, sf_dir), blobs)


@query("SELECT c.c_custkey AS marker, o.o_orderkey AS run, count(l.l_orderkey) AS records FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_partkey % 5 = c.c_custkey % 5 GROUP BY ALL")
def joi12_markers_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-12, JOI-19: composite keys, left outer."""
    markers = tab(spark, sf_dir, "customer").select(F.col("c_custkey").alias("marker"), (F.col("c_custkey") % 5).alias("binding"))
    runs = _runs(spark, sf_dir).where("state = 'F'").withColumnRenamed("scope", "marker")
    return L.marker_records(markers, runs, _records(spark, sf_dir).withColumn("binding", F.col("blob") % 5), "binding").withColumnRenamed("run_id", "run")


@query("SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_turns, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def joi15_conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-14, JOI-15, CNV-01."""
    return conversations.listed(tab(spark, sf_dir, "conversations"))


@query("WITH prior AS (SELECT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'F'), now AS (SELECT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O') SELECT count(*) AS gone FROM (SELECT DISTINCT id FROM prior) p WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.id = p.id)")
def joi20_self_anti_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return L.gone_count(r.where("state = 'F'"), r.where("state = 'O'"), "run_id")


@query("SELECT DISTINCT l_partkey, l_suppkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' AND l_discount > 0.05")
def joi21_distinct_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-21, JOI-22, SET-07."""
    records = _records(spark, sf_dir).where("share > 0.05").select("run_id", F.col("blob").alias("l_partkey"), F.col("source_id").alias("l_suppkey"))
    runs = _runs(spark, sf_dir).where("priority like '1%'").select("run_id", F.col("state").alias("o_orderstatus"))
    return L.representations(records, runs, ["l_partkey", "l_suppkey", "o_orderstatus"])


@query("SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey AND (o.o_orderstatus = 'O' OR s.s_acctbal < 0) GROUP BY 1")
def joi23_or_over_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tab(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    rows = _records(spark, sf_dir).select("run_id", F.col("source_id").alias("s_suppkey"))
    runs = _runs(spark, sf_dir).select("run_id", F.col("state").alias("run_state"))
    return T.counted_either(rows, s, runs, "s_suppkey", "run_id", (F.col("run_state") == "O") | (F.col("s_acctbal") < 0))


@query("SELECT o_orderkey, coalesce(s, 0) AS bytes FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey")
def joi25_sum_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = _records(spark, sf_dir).where("flag = 'A'")
    return T.sum_or_zero(_runs(spark, sf_dir), children, "run_id", "bytes", "bytes").withColumnRenamed("run_id", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49) AND o_orderstatus = 'O'")
def joi27_lease_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-24, JOI-27."""
    leases = _records(spark, sf_dir).where("bytes >= 49")
    return L.guarded(_runs(spark, sf_dir).where("state = 'O'"), leases, "run_id").select(F.col("run_id").alias("o_orderkey"))


# --- aggregates ---


@query(f"WITH {D} SELECT CASE WHEN source IS NOT NULL THEN 'source' WHEN media_type IS NOT NULL THEN 'media_type' ELSE 'status' END AS dimension, coalesce(source, media_type, status) AS value, count(*) AS n FROM docs WHERE NOT deleted GROUP BY GROUPING SETS ((source), (media_type), (status))")
def agg02_document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02: three groupings in one pass."""
    return T.statistics(docs(spark, sf_dir).where("not deleted"))


@query(f"WITH {fx.CHUNKS}, {D}, {MANUAL} SELECT collection_id, count(DISTINCT document_id) AS n_documents, coalesce(sum(n), 0)::BIGINT AS n_chunks FROM manual LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) USING (document_id) GROUP BY 1")
def agg05_collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.collection_counts(manual_members(spark, sf_dir), fx.chunks(spark, sf_dir))


@query(f"WITH {D}, {MANUAL}, {RULED} SELECT document_id FROM docs WHERE document_id NOT IN (SELECT document_id FROM manual UNION SELECT document_id FROM ruled)")
def agg06_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.members(manual_members(spark, sf_dir), ruled_members(spark, sf_dir)).select("document_id")
    return docs(spark, sf_dir).join(m, "document_id", "left_anti").select("document_id")


@query(f"WITH {fx.CHUNKS} SELECT count(*) FILTER (token_count > 60) AS over, coalesce(max(token_count), 0) AS longest FROM chunks")
def agg07_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, EMB-10."""
    return embedding.over_budget(fx.chunks(spark, sf_dir), 60)


@query("SELECT l_partkey, l_suppkey, count(*) AS n, coalesce(round(sum(l_quantity), 2), 0) AS bytes FROM lineitem GROUP BY 1, 2")
def agg08_blob_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).select(F.col("blob").alias("l_partkey"), F.col("source_id").alias("l_suppkey"), "bytes")
    return T.blob_bytes(r, ["l_partkey", "l_suppkey"], "bytes")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def agg09_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.state_counters(_runs(spark, sf_dir).withColumnRenamed("scope", "o_custkey"), "o_custkey", "state", ("F", "O", "P"))


@query("SELECT coalesce(json_extract_string(props, '$.reason'), event_type, 'unknown') AS reason, count(*) AS n FROM events GROUP BY 1")
def agg10_omission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, AGG-16."""
    return L.omission_reasons(tab(spark, sf_dir, "events"), T.json_field("props", "$.reason"), F.col("event_type"))


@query("SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) + 1 AS next_version, count(DISTINCT json_extract_string(props, '$.k') || '/' || event_type) AS n FROM events GROUP BY 1")
def agg12_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, AGG-12."""
    return T.next_versions(tab(spark, sf_dir, "events"), "user_id", T.json_field("props", "$.k", "long"), [T.json_field("props", "$.k"), F.col("event_type")])


@query("SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25")
def agg13_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, TEL-01: a page of the log and its total."""
    errors = tab(spark, sf_dir, "events").where("event_type = 'error'")
    return T.page_with_total(errors, [F.desc("ts"), F.col("event_id")], 25, 25).select("event_id", "user_id", "total")


@query("""WITH l AS (SELECT l_orderkey AS run, l_partkey || ':' || l_suppkey AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_linenumber) - 1 AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
b AS (SELECT run, k // 3 AS block, sha256(string_agg(line, chr(10) ORDER BY k)) AS digest, count(*) AS n FROM l GROUP BY ALL)
SELECT run, sha256(string_agg(digest, chr(10) ORDER BY block)) AS manifest, sum(n)::BIGINT AS n FROM b GROUP BY run""")
def agg15_manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, LIF-04: a digest of each run's records in order, by blocks of three lines."""
    records = L.guarded(_records(spark, sf_dir), _runs(spark, sf_dir), "run_id")
    found = L.manifest(records, F.concat_ws(":", "blob", "source_id"), ["blob", "source_id", "bytes", "ordinal"], block=3)
    return found.select(F.col("run_id").alias("run"), "manifest", "n")


@query(f"WITH {D} SELECT count(*) AS documents, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed, sum(n_chars)::BIGINT AS chars FROM docs")
def agg17_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.totals(docs(spark, sf_dir))


# --- windows ---


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1")
def win01_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, WIN-08, JOI-13."""
    o = tab(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return C.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS ordinal FROM conversations QUALIFY ordinal > 2 AND ordinal <= 5")
def win02_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, SRC-18: resume at an ordinal."""
    return T.ordinals(tab(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 2, 3).select("conv_id", "turn", "ordinal")


@query(f"WITH {fx.CHUNKS} SELECT chunk_id, coalesce(lag(token_count) OVER (PARTITION BY document_id ORDER BY position), 0) AS before, least(64, coalesce(lag(token_count) OVER (PARTITION BY document_id ORDER BY position), 0) // 2)::INTEGER AS overlap FROM chunks")
def win06_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, WIN-06: the chunk before, and how much of it may be repeated."""
    return chunking.neighbours(fx.chunks(spark, sf_dir), 64).select("chunk_id", "before", "overlap")


MESSAGES = r"messages AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '\S+'))::BIGINT AS tokens FROM conversations)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("tokens"))


@query(f"WITH {MESSAGES}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM messages) SELECT conv_id, turn, used FROM r WHERE used <= 120")
def win07_history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07, GEN-01."""
    return C.history_cut(_messages(spark, sf_dir), 120).select("conv_id", "turn", "used")


@query("SELECT conv_id, turn, next_turn AS answer_turn FROM (SELECT *, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def win07_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paired(_messages(spark, sf_dir))


# --- sets, tables ---


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (500, 7000) ORDER BY o_custkey, o_orderkey LIMIT 100")
def srt04_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04, SET-02."""
    return T.keyset_page(tab(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], (500, 7000), 100).select("o_orderkey", "o_custkey")


@query(f"WITH {FOUND}, {HAVE} SELECT document_id FROM have EXCEPT SELECT document_id FROM found")
def set03_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.difference(_have(spark, sf_dir), _found(spark, sf_dir), "document_id")


STAGES = "l AS (SELECT event_type || '-' || user_id AS name, count(*)::VARCHAR AS config FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type || '-' || user_id AS name, count(*)::VARCHAR AS config FROM events WHERE event_id % 2 = 1 GROUP BY 1)"


@query(f"WITH {STAGES} SELECT coalesce(l.name, r.name) AS name, CASE WHEN l.name IS NULL THEN 'right' WHEN r.name IS NULL THEN 'left' ELSE 'differs' END AS delta FROM l FULL JOIN r USING (name) WHERE l.config IS DISTINCT FROM r.config")
def set05_stage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: stages of two configurations, each the counts of one half of the events."""
    e = tab(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "event_type", "user_id").alias("name"))
    left, right = (e.where(F.col("event_id") % 2 == half).groupBy("name").agg(F.count(F.lit(1)).cast("string").alias("config")) for half in (0, 1))
    return C.stage_delta(left, right)


@query("SELECT round(sum(p_retailprice), 2) AS bytes, count(*) AS blobs FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 100 = 0) x JOIN part ON p_partkey = l_partkey WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 100 <> 0 AND l_quantity > 40)")
def set06_freed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06, LIF-13: what deleting some runs would free."""
    r = _records(spark, sf_dir)
    blobs = tab(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob"), F.col("p_retailprice").alias("bytes"))
    return L.freed(blobs, r.where("run_id % 100 = 0"), r.where("run_id % 100 <> 0 and bytes > 40"))


OLD_NEW = "o AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, 'new' AS v FROM orders WHERE o_orderkey % 4 = 0)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = tab(spark, sf_dir, "orders")
    return o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v")), o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("v"))


@query(f"WITH {OLD_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def dml01_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-01, DML-03, LIF-01."""
    return C.appended(*_old_new(spark, sf_dir), ["id"])


@query(f"WITH {OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def dml02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upserted(*_old_new(spark, sf_dir), ["id"])


@query(f"WITH {OLD_NEW} SELECT id, CASE WHEN n.v IS NOT NULL AND (n.id % 8 = 0 OR o.v IS NULL) THEN n.v ELSE o.v END AS v FROM o FULL JOIN n USING (id)")
def snk01_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the legacy publication replace, all others only insert."""
    old, new = _old_new(spark, sf_dir)
    return C.upserted(old, new, ["id"], F.col("id") % 8 != 0)


@query("WITH c AS (SELECT o_orderkey AS id, o_orderkey % 5 AS revision FROM orders WHERE o_orderkey % 7 <> 0), p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 END AS expected FROM orders) SELECT p.id, CASE WHEN c.revision IS NOT DISTINCT FROM p.expected THEN coalesce(c.revision, 0) + 1 ELSE c.revision END AS revision, CASE WHEN c.revision IS NOT DISTINCT FROM p.expected THEN 'published' ELSE 'superseded' END AS outcome FROM p LEFT JOIN c USING (id)")
def dml04_compare_and_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-04, SNK-02."""
    o, k = tab(spark, sf_dir, "orders"), F.col("o_orderkey")
    now = o.where("o_orderkey % 7 <> 0").select(k.alias("id"), (k % 5).alias("revision"))
    return C.swapped(now, o.select(k.alias("id"), F.when(k % 7 != 0, k % 3).alias("expected")), "id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def lif02_record_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-02, DML-05: an event log folded to each key's last state."""
    return C.folded(tab(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


# --- history, lifecycle ---


@query("SELECT user_id AS document_id, event_id AS at, event_type AS content_hash, version FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS version FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events)) WHERE new = 1")
def his01_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tab(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("at"), F.col("event_type").alias("content_hash"))
    return C.versions(e)


#: Citations of documents by number, a sixth of which are of none.
CITED = "many AS (SELECT count(*) * 6 // 5 AS n FROM documents), cited AS (SELECT o_orderkey % n || '-' || (o_orderkey % 4) AS chunk_id, o_orderkey % n AS document_id FROM orders, many), old AS (SELECT DISTINCT doc_id AS document_id FROM documents WHERE doc_id % 2 = 0)"


@query(f"WITH {fx.CHUNKS}, {D}, {CITED} SELECT c.chunk_id, c.document_id, CASE WHEN d.deleted IS NULL THEN 'unknown' WHEN d.deleted THEN 'deleted' WHEN k.chunk_id IS NOT NULL THEN 'present' WHEN old.document_id IS NOT NULL THEN 'superseded' ELSE 'unknown' END AS state FROM cited c LEFT JOIN docs d USING (document_id) LEFT JOIN chunks k USING (chunk_id) LEFT JOIN old ON old.document_id = c.document_id")
def his02_resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, many = F.col("o_orderkey"), tab(spark, sf_dir, "documents").count() * 6 // 5
    cited = tab(spark, sf_dir, "orders").select(F.concat_ws("-", k % many, k % 4).alias("chunk_id"), (k % many).alias("document_id"))
    old = tab(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"))
    return C.citation_states(cited, fx.chunks(spark, sf_dir), docs(spark, sf_dir), old)


@query("SELECT o_orderkey AS version, (o_orderdate + INTERVAL 30 DAY) AS restorable_until, o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1998-01-01' AS purged FROM orders WHERE o_orderstatus = 'F'")
def his04_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS-03, HIS-04: what may still be restored."""
    rows = _runs(spark, sf_dir).where("state = 'F'").select(F.col("run_id").alias("version"), F.col("at").alias("deleted_at"))
    return C.trash(rows, F.lit("1998-01-01").cast("timestamp_ntz")).select("version", "restorable_until", "purged")


@query(f"WITH {D}, e AS (SELECT document_id AS src, (document_id * 3) % (SELECT count(*) FROM documents) AS dst, 'k' || (document_id % 2) AS kind FROM docs), b AS (SELECT * FROM e UNION SELECT dst, src, kind FROM e), v AS (SELECT document_id AS id FROM docs WHERE status = 'indexed' AND NOT deleted) SELECT * FROM b WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def org04_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    many = tab(spark, sf_dir, "documents").count()
    edges = d.select(F.col("document_id").alias("src"), ((F.col("document_id") * 3) % many).alias("dst"), F.concat(F.lit("k"), F.col("document_id") % 2).alias("kind"))
    return C.related(edges, d.where("status = 'indexed' and not deleted").select(F.col("document_id").alias("id")))


@query(r"SELECT c_custkey, lower(trim(regexp_replace('  ' || c_name || '   ' || c_mktsegment || ' ', '\s+', ' ', 'g'))) AS name FROM customer")
def org01_collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.functions.text import collapse

    return tab(spark, sf_dir, "customer").select("c_custkey", F.lower(collapse(F.concat(F.lit("  "), "c_name", F.lit("   "), "c_mktsegment", F.lit(" ")))).alias("name"))


@query(f"WITH {FOUND}, {HAVE}, s AS (SELECT count(*) AS live, count(*) FILTER (f.document_id IS NULL) AS missing FROM have h LEFT JOIN (SELECT DISTINCT document_id FROM found) f USING (document_id)) SELECT live, missing, round(missing / live, 6) AS share, CASE WHEN missing / live > 0.05 THEN 'proposed' ELSE 'applied' END AS outcome FROM s")
def lif08_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-08, AGG-18."""
    return C.reconciled(_have(spark, sf_dir), _found(spark, sf_dir), "document_id", 0.05)


@query("SELECT l_orderkey AS run, count(*) FILTER (l_returnflag = 'R') AS missing, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'complete' ELSE 'partial' END AS completeness FROM lineitem GROUP BY 1")
def lif03_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.completeness(_records(spark, sf_dir), F.col("flag") == "R").withColumnRenamed("run_id", "run")


@query(f"WITH {FOUND}, {HAVE} SELECT f.document_id FROM found f JOIN have h ON h.document_id = f.document_id AND h.token = f.token")
def lif05_reuse_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies kept from an earlier run, by equal and known version token."""
    return L.reusable(_found(spark, sf_dir), _have(spark, sf_dir)).select("document_id")


@query("SELECT o_orderkey, CASE WHEN datediff('day', o_orderdate, TIMESTAMP '1998-06-01') >= 7 THEN 'due' ELSE 'waits' END AS reconcile, o_orderstatus = 'O' AND o_orderdate + INTERVAL 1 HOUR < TIMESTAMP '1998-06-01' AS requeue FROM orders")
def lif09_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-09, LIF-14: due checks against a fixed clock."""
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    return _runs(spark, sf_dir).select(F.col("run_id").alias("o_orderkey"), L.reconcile_due(F.col("at"), now).alias("reconcile"), L.interrupted(F.col("state"), ("O",), F.col("at"), now).alias("requeue"))


@query("WITH n AS (SELECT (SELECT count(*) FROM lineitem) AS records, sum(length(text))::BIGINT AS bytes, count(*) FILTER (length(text) > 10000) AS backlog FROM documents) SELECT *, concat_ws('+', CASE WHEN records > 10000000 THEN 'records' END, CASE WHEN bytes > 10000000000 THEN 'bytes' END, CASE WHEN backlog > 3 THEN 'backlog' END) AS exceeded, records <= 10000000 AND bytes <= 10000000000 AND backlog <= 3 AS admitted FROM n")
def lif07_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs against limits, one of which is exceeded here."""
    records = _records(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"))
    needs = records.crossJoin(tab(spark, sf_dir, "documents").agg(F.sum(F.length("text")).alias("bytes"), F.count_if(F.length("text") > 10_000).alias("backlog")))  # one row each
    return L.capacity(needs, {"records": 10_000_000, "bytes": 10_000_000_000, "backlog": 3}).select("records", "bytes", "backlog", "exceeded", "admitted")


@query(f"WITH {D} SELECT document_id, concat_ws('+', CASE WHEN (status = 'failed') <> (document_id % 2 = 0) THEN 'failed_stage' END, CASE WHEN status IN ('failed', 'no_extractable_text') AND document_id % 5 <> 0 THEN 'status_detail' END) AS broken FROM docs WHERE (status = 'failed') <> (document_id % 2 = 0) OR (status IN ('failed', 'no_extractable_text') AND document_id % 5 <> 0)")
def grd05_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("failed_stage", F.when(F.col("document_id") % 2 == 0, "parse")).withColumn("status_detail", F.when(F.col("document_id") % 5 == 0, "said"))
    return C.violations(d)


@query(f"WITH {fx.CHUNKS}, {D} SELECT count(*) AS leaks FROM (SELECT chunk_id, document_id FROM chunks WHERE token_count > 50) h WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.document_id = h.document_id AND d.status = 'indexed' AND NOT d.deleted)")
def grd02_scope_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fx.chunks(spark, sf_dir).where("token_count > 50").select("chunk_id", "document_id")
    return T.leaks(hits, docs(spark, sf_dir).where("status = 'indexed' and not deleted")).agg(F.count(F.lit(1)).alias("leaks"))


@query(f"WITH {HAVE}, n AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN doc_id % 5 <> 0 THEN 'pub2' END AS publication FROM documents WHERE doc_id % 2 = 0) SELECT h.document_id, coalesce(n.status, 'indexed') AS status, coalesce(n.publication, CASE WHEN h.document_id % 3 = 0 THEN 'pub0' END, 'pub1') AS publication FROM have h LEFT JOIN n USING (document_id)")
def grd06_last_good_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed run is recorded, the last good publication stays."""
    i = F.col("doc_id")
    outcomes = tab(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(i.alias("document_id"), F.when(i % 5 == 0, "failed").otherwise("indexed").alias("status"), F.lit("pub2").alias("publication"))
    current = _have(spark, sf_dir).select("document_id", F.when(F.col("document_id") % 3 == 0, "pub0").alias("publication"))
    return L.last_good(current, outcomes)


@query(r"SELECT page_id, concat_ws('+', CASE WHEN length(url) > 45 THEN 'long' END, CASE WHEN NOT regexp_matches(url, '^https?://[^/?#]+') THEN 'uri' END, CASE WHEN regexp_matches(url, '[\x00-\x1f]') THEN 'unprintable' END, CASE WHEN len(string_split(url, '/')) > 4 THEN 'sections' END) AS refused FROM pages")
def grd08_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    return tab(spark, sf_dir, "pages").select("page_id", T.provenance_problems(F.col("url"), F.col("url"), parts, 45, 4).alias("refused"))


def _state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of records: one record per user and day."""
    t = F.col("event_type")
    state = F.when(t == "signup", "listed").when(t == "click", "fetching").when(t == "view", "fetched").when(t == "error", "failed").otherwise("derived")
    return tab(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("date").cast("string").alias("source_id"), F.col("event_id").alias("seq"), state.alias("state"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS run_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS k, CASE event_type WHEN 'signup' THEN 'listed' WHEN 'click' THEN 'fetching' WHEN 'view' THEN 'fetched' WHEN 'error' THEN 'failed' ELSE 'derived' END AS state FROM events),
m(a, b) AS (VALUES ('', 'listed'), ('listed', 'fetching'), ('fetching', 'fetched'), ('fetching', 'failed'), ('failed', 'fetching'), ('fetched', 'derived'), ('fetched', 'failed')),
r AS (SELECT DISTINCT run_id, source_id, 0::BIGINT AS k, '' AS state, 0 AS refused FROM e
 UNION ALL SELECT r.run_id, r.source_id, e.k, CASE WHEN m.a IS NOT NULL THEN e.state ELSE r.state END, r.refused + CASE WHEN m.a IS NULL THEN 1 ELSE 0 END FROM r JOIN e ON e.run_id = r.run_id AND e.source_id = r.source_id AND e.k = r.k + 1 LEFT JOIN m ON m.a = r.state AND m.b = e.state)
SELECT run_id, source_id, nullif(arg_max(state, k), '') AS state, max(refused) AS refused FROM r GROUP BY 1, 2""")
def lif02_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-02: events folded through the machine of record states; moves it doesn't have are counted and refused."""
    return L.settled(_state_events(spark, sf_dir))


@query("""WITH page AS (SELECT l_orderkey AS run_id, l_suppkey AS source_id, l_linenumber AS ordinal FROM lineitem WHERE l_linenumber > 2), had AS (SELECT l_orderkey AS run_id, l_suppkey AS source_id, l_linenumber AS ordinal FROM lineitem WHERE l_linenumber = 1)
SELECT * FROM had UNION ALL SELECT run_id, source_id, min(ordinal) FROM page p WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.run_id = p.run_id AND h.source_id = p.source_id) GROUP BY 1, 2""")
def lif01_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-01: a page of listed records appended, one of each source."""
    r = _records(spark, sf_dir).select("run_id", "source_id", "ordinal")
    return L.enumerated(r.where("ordinal = 1"), r.where("ordinal > 2"))


@query("""WITH c AS (SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag = 'R') = 0 AS whole, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 6 = 0 OR c.n IS NULL THEN 'manifest_mismatch' WHEN NOT coalesce(whole, false) THEN 'incomplete' ELSE 'promoted' END AS outcome,
 o_orderkey % 6 <> 0 AND c.n IS NOT NULL AND coalesce(whole, false) AND o_orderkey % 4 = 1 AS moves_watermark FROM orders LEFT JOIN c ON c.run_id = o_orderkey""")
def lif03_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-03, LIF-04: promotion of complete runs whose manifest verifies, and whether the watermark moves."""
    records, k = _records(spark, sf_dir), F.col("run_id")
    counts = records.groupBy("run_id").agg(F.count(F.lit(1)).cast("string").alias("manifest"))
    runs = _runs(spark, sf_dir).join(counts, "run_id", "left").select("run_id", F.concat(F.lit("c"), k % 4).alias("connector"), F.lit("s").alias("scope"), F.when(k % 4 == 1, 7).otherwise(6).alias("base_watermark"), F.when(k % 6 == 0, "other").otherwise(F.coalesce("manifest", F.lit("none"))).alias("manifest"))
    marks = spark.createDataFrame([(f"c{i}", 7, "s") for i in range(4)], "connector string, watermark int, scope string")
    return L.promoted(runs, L.completeness(records, F.col("flag") == "R"), counts, marks)


@query(f"""WITH {HAVE}, p AS (SELECT doc_id AS document_id, 'v' || (doc_id % 3) AS token, 's' || (doc_id % 2) AS scope FROM documents), r(run_id, scope, promoted_at, good) AS (VALUES (1, 's0', 5, true), (2, 's0', 6, true), (3, 's0', 9, false), (4, 's1', 4, true)),
n AS (SELECT scope, arg_max(run_id, promoted_at) AS run_id FROM r WHERE good GROUP BY 1)
SELECT p.document_id FROM p JOIN n USING (scope) JOIN have h ON h.document_id = p.document_id AND h.token = p.token AND h.document_id % 5 = n.run_id""")
def lif05_reuse_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-05: bodies of the newest promoted run of the same scope whose manifest verifies."""
    i = F.col("doc_id")
    found = tab(spark, sf_dir, "documents").select(i.alias("document_id"), F.concat(F.lit("v"), i % 3).alias("token"), F.concat(F.lit("s"), i % 2).alias("scope"))
    have = _have(spark, sf_dir).withColumn("run_id", (F.col("document_id") % 5).cast("int"))
    runs = spark.createDataFrame([(1, "s0", 5, True), (2, "s0", 6, True), (3, "s0", 9, False), (4, "s1", 4, True)], "run_id int, scope string, promoted_at int, verified boolean")
    return L.reusable(found, have, "document_id", runs).select("document_id")


def _rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("document_id")
    d = docs(spark, sf_dir).select("document_id", (i + i % 3).alias("blob"), "deleted", F.when(i % 3 != 0, F.concat(F.lit("p"), i % 4)).alias("parse_fp"))
    blobs = tab(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob"), F.length("text").alias("bytes"))
    return L.rebuild_plan(d, blobs, 6000, {"parse_fp": "p1"})


PLAN = f"""{D}, plan AS (SELECT document_id, CASE WHEN parse_fp = 'p1' THEN 'keep' WHEN bytes IS NULL OR bytes > 6000 THEN 'refuse' ELSE 'derive' END AS action, CASE WHEN parse_fp = 'p1' THEN NULL WHEN bytes IS NULL THEN 'body_missing' WHEN bytes > 6000 THEN 'body_too_large' END AS refusal
 FROM (SELECT document_id, document_id + document_id % 3 AS blob, coalesce(CASE WHEN document_id % 3 <> 0 THEN 'p' || (document_id % 4) END, '') AS parse_fp FROM docs WHERE NOT deleted) LEFT JOIN (SELECT doc_id AS blob, length(text) AS bytes FROM documents) USING (blob))"""


@query(f"WITH {PLAN} SELECT * FROM plan")
def lif10_rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-10: what a rebuild keeps, derives and refuses, with the reason."""
    return _rebuild(spark, sf_dir)


@query(f"""WITH {PLAN}, b AS (SELECT document_id FROM plan WHERE action <> 'refuse' AND document_id % 10 <> 0 UNION ALL SELECT document_id FROM docs WHERE document_id % 25 = 0), a AS (SELECT document_id FROM plan WHERE action <> 'refuse')
SELECT document_id, 'not_built' AS problem FROM a WHERE document_id NOT IN (SELECT document_id FROM b) UNION ALL SELECT DISTINCT document_id, 'not_planned' FROM b WHERE document_id NOT IN (SELECT document_id FROM a) UNION ALL SELECT document_id, 'built_twice' FROM b GROUP BY 1 HAVING count(*) > 1""")
def lif10_rebuild_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-10, LIF-11: what a built generation lacks or has too much of."""
    plan = _rebuild(spark, sf_dir)
    built = plan.where("action <> 'refuse' and document_id % 10 <> 0").select("document_id").unionByName(docs(spark, sf_dir).where("document_id % 25 = 0").select("document_id"))
    return L.rebuild_problems(plan, built)


@query(f"WITH {fx.CHUNKS}, {D} SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM docs WHERE NOT deleted)")
def dml06_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-06, LIF-15: index entries whose document is gone or deleted."""
    return L.tombstones(fx.chunks(spark, sf_dir), docs(spark, sf_dir)).select("chunk_id")


@query("SELECT o_orderkey AS document_id, CASE WHEN o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1996-01-01' THEN 'expired' WHEN EXISTS (SELECT 1 FROM orders r WHERE r.o_orderstatus = 'O' AND r.o_custkey = o.o_custkey) THEN 'rival' ELSE 'restored' END AS verdict FROM orders o WHERE o_orderstatus = 'F'")
def dml05_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-05: restore from the trash, unless the time is over or a rival has the identity."""
    o = _runs(spark, sf_dir).select(F.col("run_id").alias("document_id"), F.col("scope").alias("identity"), "state", F.col("at").alias("deleted_at"))
    return L.restorable(o.where("state = 'F'"), o.where("state = 'O'"), ["identity"], F.lit("1996-01-01").cast("timestamp_ntz"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def cnv01_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNV-01: the last messages of each conversation, oldest first."""
    return conversations.history(tab(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "place")


@query("WITH f AS (SELECT user_id % 87 AS conv_id, event_id % 8 AS turn, event_id AS seen, event_type AS feedback FROM events) SELECT m.conv_id, m.turn, x.feedback FROM conversations m LEFT JOIN (SELECT conv_id, turn, arg_max(feedback, seen) AS feedback FROM f GROUP BY 1, 2) x ON x.conv_id = m.conv_id AND x.turn = m.turn WHERE m.role = 'assistant'")
def cnv01_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNV-01: the last feedback on each answer."""
    e = tab(spark, sf_dir, "events")
    given = e.select((F.col("user_id") % 87).alias("conv_id"), (F.col("event_id") % 8).alias("turn"), F.col("event_id").alias("at"), F.col("event_type").alias("feedback"))
    return conversations.with_feedback(tab(spark, sf_dir, "conversations"), given)


@query("SELECT md5(o_orderkey::VARCHAR) AS token_hash, o_custkey AS conv_id FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey % 5 = 0 OR o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-01-01')")
def cnv01_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNV-01: shares that may still be opened."""
    k = F.col("run_id")
    shares = _runs(spark, sf_dir).select(F.md5(k.cast("string")).alias("token_hash"), F.col("scope").alias("conv_id"), (F.col("state") == "P").alias("revoked"), F.when(k % 5 != 0, F.col("at") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return conversations.shareable(shares, F.lit("1998-01-01").cast("timestamp_ntz"))
