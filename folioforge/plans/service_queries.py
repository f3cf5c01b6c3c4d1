"""Registered queries of service operators: rules, changes, releases, impacts, audits, prompts; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import analytics as A
from folioforge.operators import conversations, evaluation
from folioforge.operators import corpus as C
from folioforge.operators import lifecycle as L
from folioforge.operators import retrieval as R
from folioforge.operators import store as T
from folioforge.plans import corpus_queries as Q
from folioforge.plans import fixtures as fx
from folioforge.plans import retrieval_queries as Z
from folioforge.plans.registry import Registry
from folioforge.plans.scratch import new_dir

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL


@query(Z.SQL["ret14_rerank"])
def ret14_rerank_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-14: a scorer handed in, loaded once per task, over batches of pairs."""
    found = Z.best_chunks(spark, sf_dir, 20)
    made = R.reranked(found, fx.chunks(spark, sf_dir), fx.questions(spark, sf_dir), 20, R.overlap_scorer)
    return made.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {fx.DOCUMENTS}, live AS (SELECT * FROM docs WHERE NOT deleted), t AS (SELECT * FROM live ORDER BY updated_s DESC, document_id LIMIT 50), {fx.CHUNKS}
SELECT 'document_list' AS kind, count(*) || ' document(s): ' || string_agg(source || '/' || document_id, ', ' ORDER BY updated_s DESC, document_id) AS text, count(*) AS n FROM t
UNION ALL SELECT 'document_count', count(*) || ' document(s) are indexed', count(*) FROM live UNION ALL SELECT 'index_status', count(*) || ' chunk(s) indexed, embedded by stand-in', count(*) FROM chunks""")
def ret17_utility_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-17: the list of the latest fifty, the count, the state of the index."""
    titled = fx.documents(spark, sf_dir).withColumn("title", F.concat_ws("/", "source", "document_id"))
    return T.utility_answers(titled, fx.chunks(spark, sf_dir), "stand-in")


HISTORY = """h AS (SELECT user_id AS document_id, event_id AS "at", event_type AS content_hash, value, props, length(props) AS chunk_count FROM events),
k AS (SELECT * FROM (SELECT *, lag(content_hash) OVER (PARTITION BY document_id ORDER BY "at") AS before FROM h) WHERE before IS DISTINCT FROM content_hash),
v AS (SELECT *, row_number() OVER w AS version, lag(content_hash) OVER w AS h0, lag(value::VARCHAR) OVER w AS v0, lag(props) OVER w AS p0 FROM k WINDOW w AS (PARTITION BY document_id ORDER BY "at"))"""


@query(f"""WITH {HISTORY} SELECT document_id, "at", version::INTEGER AS version, chunk_count, CASE WHEN version > 1 AND props IS DISTINCT FROM p0 THEN p0 || '>' || props END AS props_moved, CASE WHEN version > 1 THEN h0 || '>' || content_hash END AS hash_moved,
CASE WHEN version = 1 THEN 0 ELSE (h0 IS DISTINCT FROM content_hash)::INTEGER + (v0 IS DISTINCT FROM value::VARCHAR)::INTEGER + (p0 IS DISTINCT FROM props)::INTEGER END AS n_changed FROM v""")
def his01_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS-01: revisions with their chunk counts and what moved between them."""
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("at"), F.col("event_type").alias("content_hash"), "value", "props", F.length("props").alias("chunk_count"))
    found = C.version_changes(e, ["content_hash", "value", "props"])
    moved = lambda name: F.concat(F.col("changes")[name]["before"], F.lit(">"), F.col("changes")[name]["after"])
    return found.select("document_id", "at", "version", "chunk_count", moved("props").alias("props_moved"), moved("content_hash").alias("hash_moved"), F.size("changes").alias("n_changed"))


VERSIONS = "v AS (SELECT o_custkey AS document_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderdate AS moment, CASE WHEN o_orderkey % 4 <> 0 THEN md5(o_orderkey::VARCHAR) END AS blob FROM orders)"


@query(f"WITH {VERSIONS}, n AS (SELECT *, lead(moment) OVER (PARTITION BY document_id ORDER BY version) AS after FROM v) SELECT id, CASE WHEN coalesce(after < TIMESTAMP '1996-01-01', false) THEN NULL ELSE blob END AS blob, blob IS NOT NULL AND coalesce(after < TIMESTAMP '1996-01-01', false) AS released FROM n")
def his03_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS-03: bodies of versions superseded before a day are let go, and the rows say so."""
    o, k = fx.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    versions = o.select(F.col("o_custkey").alias("document_id"), k.alias("id"), place.alias("version"), F.col("o_orderdate").alias("at"), F.when(k % 4 != 0, F.md5(k.cast("string"))).alias("blob"))
    return L.released(versions, F.lit("1996-01-01").cast("timestamp_ntz")).select("id", "blob", "released")


@query("""WITH a AS (SELECT event_id AS id, ts AS moment, event_type AS event, user_id FROM events WHERE event_type IN ('error', 'purchase') AND ts >= (SELECT min(ts) FROM events) + INTERVAL 5 DAY)
SELECT id, event, (SELECT count(*) FROM a) AS total FROM a ORDER BY moment DESC, id DESC LIMIT 200 OFFSET 20""")
def tel01_audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEL-01: a page of the audit log, by kind of event and from a time on, with the total."""
    e = fx.table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("actor"))
    first = e.agg(F.min("ts")).first()[0]
    since = F.lit(first) + F.expr("INTERVAL 5 DAYS")
    return T.audited(log, ("error", "purchase"), since, offset=20, limit=200).select("id", "event", "total")


@query("""WITH r AS (SELECT l_orderkey AS run_id, l_partkey AS blob, l_returnflag AS flag, l_linestatus AS state FROM lineitem),
x AS (SELECT 'generation_cleanup' AS action, blob, run_id % 10 < 7 AS go FROM r UNION ALL SELECT 'history_release', blob, flag = 'R' FROM r UNION ALL SELECT 'snapshot_delete', blob, state = 'F' FROM r UNION ALL SELECT 'derived_reset', blob, run_id % 2 = 0 OR flag <> 'N' FROM r),
b AS (SELECT action, blob, count(*) FILTER (go) AS n, bool_and(go) AS gone FROM x GROUP BY ALL)
SELECT action, sum(n)::BIGINT AS "references", count(*) FILTER (gone) AS blobs, round(coalesce(sum(p_retailprice) FILTER (gone), 0), 2) AS bytes FROM b JOIN part ON p_partkey = blob GROUP BY action""")
def lif13_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-13: what a reset, a cleanup, a release and a deletion would free, each on its own, in one pass."""
    r = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("blob"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"))
    blobs = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob"), F.col("p_retailprice").alias("bytes"))
    run, flag = F.col("run_id"), F.col("flag")
    return L.impacts(r, blobs, {"generation_cleanup": run % 10 < 7, "history_release": flag == "R", "snapshot_delete": F.col("state") == "F", "derived_reset": (run % 2 == 0) | (flag != "N")})


@query(f"WITH {fx.DOCUMENTS} SELECT 'late french' AS collection_id, document_id FROM docs WHERE lang = 'fr' AND updated_s > 6000 UNION ALL SELECT 'pages', document_id FROM docs WHERE media_type = 'text/html' AND source IN ('src1', 'src2', 'src3')")
def org01_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORG-01: rules of collections set, set anew under a name written otherwise, and cleared; then all members at once."""
    rules = C.Rules()
    rules.set("Late  French", C.Filter(langs=("fr",)))
    rules.set("failed", C.Filter(statuses=("failed",)))
    rules.set("Pages", C.Filter(media_types=("text/html",), sources=("src1", "src2", "src3")))
    rules.set(" late french ", C.Filter(langs=("fr",), updated_after=6000))
    rules.clear("FAILED")
    return rules.members(fx.documents(spark, sf_dir))


@query("""WITH q AS (SELECT 'set-' || (conv_id % 5) AS name, CASE WHEN turn = 3 THEN NULL ELSE 'q' || (conv_id // 5 % 40) || '-' || turn END AS id, CASE WHEN conv_id % 17 = 0 THEN ' ' ELSE text END AS text,
 CASE WHEN turn % 4 = 0 THEN '2024-05-01T10:00:00Z' WHEN turn % 4 = 1 THEN '2024-05-01 10:00:00+02:00' WHEN turn % 4 = 2 THEN '2024-05-01T10:00:00' END AS created_at FROM conversations)
SELECT 'set-' || n AS name, NULL AS id, 'schema_version' AS problem, 1 AS n FROM range(5) t(n) WHERE n % 3 = 2 AND 'set-' || n IN (SELECT name FROM q)
UNION ALL SELECT name, id, 'repeated_id', 1 FROM q WHERE id IS NOT NULL GROUP BY name, id HAVING count(*) > 1
UNION ALL SELECT name, id, problem, count(*) FROM (SELECT name, id, 'missing_id' AS problem FROM q WHERE id IS NULL UNION ALL SELECT name, id, 'empty_text' FROM q WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT name, id, 'naive_time' FROM q WHERE created_at = '2024-05-01T10:00:00') GROUP BY ALL""")
def src20_query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: what keeps query sets from being taken in: versions, ids, texts, times without an offset."""
    c, turn = fx.table(spark, sf_dir, "conversations"), F.col("turn")
    at = F.when(turn % 4 == 0, "2024-05-01T10:00:00Z").when(turn % 4 == 1, "2024-05-01 10:00:00+02:00").when(turn % 4 == 2, "2024-05-01T10:00:00")
    id_ = F.when(turn != 3, F.concat(F.lit("q"), F.floor(F.col("conv_id") / 5) % 40, F.lit("-"), turn))
    q = c.select((F.col("conv_id") % 5).alias("n"), F.struct(id_.alias("id"), F.when(F.col("conv_id") % 17 == 0, " ").otherwise(F.col("text")).alias("text"), at.alias("created_at")).alias("q"))
    sets = q.groupBy("n").agg(F.collect_list("q").alias("queries")).select(F.concat(F.lit("set-"), "n").alias("name"), F.when(F.col("n") % 3 == 2, 2).otherwise(1).alias("schema_version"), "queries")
    return evaluation.query_set_problems(sets).groupBy("name", "id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT DISTINCT md5(CASE WHEN doc_id % 5 = 0 THEN text || '?' ELSE text END) AS blob FROM documents), k AS (SELECT md5(text) AS blob, min(text) AS t FROM documents GROUP BY 1) SELECT a.blob, CASE WHEN strlen(t) > 20000 THEN 'omitted' WHEN t IS NULL THEN 'unknown' ELSE 'found' END AS state, CASE WHEN strlen(t) <= 20000 THEN length(t) END AS n_chars FROM a LEFT JOIN k USING (blob)")
def snk03_blob_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: the contents under addresses, of which some were never put and some were too large to keep."""
    d = fx.table(spark, sf_dir, "documents")
    asked = d.select(F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))).alias("blob"))
    large = T.blobs(d, "text", "doc_id", 20_000).where("omitted is not null")
    kept = d.where(F.octet_length("text") <= 20_000)
    return T.gotten(asked, kept, "text", large).select("blob", "state", F.length("text").cast("long").alias("n_chars"))


@query(r"""WITH q AS (SELECT conv_id AS query_id, conv_id, text FROM conversations WHERE turn = 0), m AS (SELECT *, length(text) // 4 + 1 AS tokens FROM conversations), h AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM m) WHERE used <= 60),
t AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS told FROM h GROUP BY 1), p AS (SELECT doc_id AS query_id, '[1] ' || split_part(text, chr(10), 1) || chr(10) || '[2] ' || source AS shown FROM documents WHERE doc_id % 3 <> 0)
SELECT query_id, md5('Answer from the passages.' || CASE WHEN shown IS NOT NULL THEN chr(10) || chr(10) || 'Passages:' || chr(10) || shown ELSE '' END || CASE WHEN told IS NOT NULL THEN chr(10) || chr(10) || 'Conversation:' || chr(10) || told ELSE '' END || chr(10) || chr(10) || 'Question: ' || q.text) AS prompt
FROM q LEFT JOIN p USING (query_id) LEFT JOIN t USING (conv_id)""")
def gen01_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-01: prompts of the system's words, numbered passages, what fits of the conversation, and the question."""
    c = fx.table(spark, sf_dir, "conversations")
    q = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), "conv_id", "text")
    d = fx.table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    parts = F.array(F.struct(F.lit(1).alias("rank"), F.substring_index("text", "\n", 1).alias("text")), F.struct(F.lit(2).alias("rank"), F.col("source").alias("text")))
    passages = d.select(F.col("doc_id").alias("query_id"), F.explode(parts).alias("p")).select("query_id", "p.*")
    sized = c.withColumn("tokens", F.floor(F.length("text") / 4) + 1)
    return conversations.prompts(q, passages, sized, "Answer from the passages.", 60).select("query_id", F.md5("prompt").alias("prompt"))


@query("SELECT c_custkey, md5('{' || CASE WHEN c_custkey % 3 <> 0 THEN '\"mktsegment\":\"' || c_mktsegment || '\",' ELSE '' END || '\"name\":\"' || c_name || '\",\"nation\":\"' || c_nationkey || '\"}') AS digest FROM customer")
def scl_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: objects in one form, whatever the order and presence of their fields."""
    fields = {"nation": F.col("c_nationkey"), "name": F.col("c_name"), "mktsegment": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))}
    return fx.table(spark, sf_dir, "customer").select("c_custkey", F.md5(X.canonical_json(fields)).alias("digest"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS a, lag(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
s AS (SELECT conv_id, turn, a, b, list_reverse(a) AS ra, list_reverse(b) AS rb FROM w WHERE b IS NOT NULL)
SELECT conv_id, turn, coalesce((SELECT min(i) FROM range(1, 1 + least(len(a), len(b))) t(i) WHERE a[i] IS DISTINCT FROM b[i]) - 1, least(len(a), len(b)))::INTEGER AS prefix, coalesce((SELECT min(i) FROM range(1, 1 + least(len(a), len(b))) t(i) WHERE ra[i] IS DISTINCT FROM rb[i]) - 1, least(len(a), len(b)))::INTEGER AS suffix FROM s""")
def scl_shared_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: words that a message has in common with the one before, from either end."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a")).withColumn("b", F.lag("a").over(w)).where("b is not null")
    return words.select("conv_id", "turn", X.shared_prefix(F.col("a"), F.col("b")).alias("prefix"), X.shared_suffix(F.col("a"), F.col("b")).alias("suffix"))


#: Manual pages: the heading is the initials of three words of the part's name or type, the line below tells of one of them.
MANUAL = """m AS (SELECT p_partkey::VARCHAR AS chunk_id, p_type || ' ' || p_name AS told, p_type || ' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_type END AS base, p_partkey % 5 AS k FROM part),
c AS (SELECT chunk_id, upper(array_to_string(list_transform(string_split(base, ' '), lambda x: x[1]), '')) AS acronym, CASE k WHEN 0 THEN told WHEN 1 THEN told || ', as it is sold' WHEN 2 THEN 'when ' || told || ' is sold' WHEN 3 THEN told || '. More of it' ELSE 'IT for ' || told END AS line FROM m),
f AS (SELECT *, upper(array_to_string(list_transform(regexp_extract_all(line, '[A-Za-z0-9]+'), lambda x: x[1]), '')) AS whole, trim(regexp_extract(line, '^([^,;:.]*)', 1)) AS head FROM c),
e AS (SELECT chunk_id, acronym, CASE WHEN whole = acronym THEN line WHEN upper(array_to_string(list_transform(regexp_extract_all(head, '[A-Za-z0-9]+'), lambda x: x[1]), '')) = acronym THEN head ELSE line END AS expansion FROM f WHERE regexp_full_match(acronym, '[A-Z][A-Z0-9]{1,11}'))"""


@query(f"WITH {MANUAL} SELECT chunk_id, acronym, expansion, CASE WHEN regexp_matches(expansion, '[.!?]\\s') THEN 'several_sentences' WHEN upper(array_to_string(list_transform(regexp_extract_all(expansion, '[A-Za-z0-9]+'), lambda x: x[1]), '')) <> acronym THEN 'unproved_heading' END AS refusal FROM e")
def glo03_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GLO-03: a heading and the line below are a definition only if one spells the other; what is refused, and why."""
    p, k = fx.table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    told = F.concat_ws(" ", "p_type", "p_name")
    base = F.when(F.col("p_partkey") % 3 == 0, told).otherwise(F.concat_ws(" ", told, "p_type"))
    line = F.when(k == 0, told).when(k == 1, F.concat(told, F.lit(", as it is sold"))).when(k == 2, F.concat(F.lit("when "), told, F.lit(" is sold"))).when(k == 3, F.concat(told, F.lit(". More of it"))).otherwise(F.concat(F.lit("IT for "), told))
    heading = F.concat(F.lit("Manual > "), F.upper(F.array_join(F.transform(F.split(base, " "), lambda w: F.substring(w, 1, 1)), "")))
    found = A.headed(p.select(F.col("p_partkey").cast("string").alias("chunk_id"), line.alias("text"), heading.alias("heading_text")))
    return found.select("chunk_id", "acronym", "expansion", A.refusal(F.col("acronym"), F.col("expansion"), F.col("form")).alias("refusal"))


@query("WITH e AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'when ' || event_type || ' is seen' WHEN 1 THEN 'there is ' || event_type WHEN 2 THEN 'IT ' || event_type ELSE event_type || ' of a user' END AS expansion FROM events) SELECT id, CASE WHEN id % 4 < 2 THEN 'refused_opening' END AS refusal FROM e")
def glo03_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GLO-03: phrases that begin as prose does, and one that begins with an acronym of the same letters."""
    k, kind = F.col("event_id") % 4, F.col("event_type")
    phrase = F.when(k == 0, F.concat(F.lit("when "), kind, F.lit(" is seen"))).when(k == 1, F.concat(F.lit("there is "), kind)).when(k == 2, F.concat(F.lit("IT "), kind)).otherwise(F.concat(kind, F.lit(" of a user")))
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), A.refusal(F.lit("ZZ"), phrase, F.lit("dash")).alias("refusal"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT doc_id AS chunk_id, line_no::INTEGER AS line_no, md5(coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '')) AS previous FROM l""")
def win05_previous_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: each line with the one before it."""
    d = fx.dealt(fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return A.with_previous(d).select("chunk_id", "line_no", F.md5("previous").alias("previous"))


@query("SELECT * FROM (SELECT o_custkey AS scope, o_orderstatus AS state FROM orders UNION SELECT l_suppkey, l_linestatus FROM lineitem) WHERE (scope, state) > (7, 'F') ORDER BY scope, state LIMIT 150")
def set02_union_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02: a page of a union, in order of keys."""
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderstatus").alias("state"))
    i = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scope"), F.col("l_linestatus").alias("state"))
    return T.union_page([o, i], ["scope", "state"], (7, "F"), 150)


@query("SELECT user_id AS query_id, props AS rater, arg_max(event_type, (event_id, event_type)) AS outcome, count(*) AS n_told FROM events GROUP BY ALL")
def snk06_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: judgements appended in two runs, of which each rater's last counts."""
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("props").alias("rater"), F.col("event_type").alias("outcome"), F.col("event_id").alias("at"))
    path = new_dir(spark, "preferences")
    evaluation.preferences(e.where("at % 2 = 0"), path)
    return evaluation.preferences(e.where("at % 2 = 1"), path)


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'keep' ELSE 'derive' END AS action, source FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 32 WHEN source IN ('src1', 'src2') THEN 128 ELSE 64 END AS size FROM documents WHERE doc_id % 11 <> 0)
SELECT action, count(*) AS planned, count(b.doc_id) AS built, count(*) FILTER (b.size <> CASE WHEN source IN ('src1', 'src2') THEN 128 ELSE 64 END) AS wrong_size FROM p LEFT JOIN b USING (doc_id) GROUP BY action""")
def lif11_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIF-11: a generation of vectors looked at against its plan: what is built, and what has another dimension than its model's."""
    d, i = fx.table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.when(F.col("source").isin("src1", "src2"), "large").otherwise("small")
    plan = d.select(i.alias("document_id"), F.when(i % 4 == 0, "keep").otherwise("derive").alias("action"), kind.alias("kind"))
    built = d.where("doc_id % 11 <> 0").select(i.alias("document_id"), F.when(i % 7 == 3, 32).when(kind == "large", 128).otherwise(64).alias("size"))
    return L.inspected(plan, built, {"small": 64, "large": 128})
