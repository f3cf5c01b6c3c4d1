"""Registered queries of single operators on rows made for them, each beside the SQL that says what must come out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import analytics as A
from folioforge.operators import chunk_plan, chunking, corpus, embedding, evaluation
from folioforge.operators import retrieval as R
from folioforge.plans import fixtures as fx
from folioforge.plans.registry import Registry
from folioforge.sources import filesystem as S
from folioforge.streaming import watch

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n")))


# --- sources ---


@query("SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'https://e.org/p?c=' || s_suppkey WHEN 1 THEN 'https://e.org/q/' || s_suppkey END AS next FROM supplier")
def src12_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: a relative link, one to the same origin, one elsewhere, and the end."""
    k = F.col("k")
    link = F.when(k % 4 == 0, F.concat(F.lit("/p?c="), k)).when(k % 4 == 1, F.concat(F.lit("https://e.org/q/"), k)).when(k % 4 == 2, F.concat(F.lit("https://other.org/"), k))
    payload = F.to_json(F.struct(F.struct(link.alias("next")).alias("_links")))
    return _suppliers(spark, sf_dir).select("k", S.next_page(payload, F.lit("https://e.org/wiki")).alias("next"))


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'content' ELSE '' END || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN '+' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'lineage' ELSE '' END || CASE WHEN (doc_id % 5 = 0 OR doc_id % 3 = 0) AND doc_id % 7 = 0 THEN '+' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN 'routing' ELSE '' END AS changed FROM documents")
def flt11_lineage_and_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: changes of content, of what it was derived by, and of where it is stored."""
    i = F.col("document_id")
    old = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("a").alias("content_hash"), F.lit(None).cast("string").alias("parse_fp"), F.lit("p").alias("publication_id"))
    new = old.select(i, F.when(i % 5 == 0, "b").otherwise("a").alias("content_hash"), F.when(i % 3 == 0, "x").alias("parse_fp"), F.when(i % 7 == 0, "q").otherwise("p").alias("publication_id"))
    return corpus.change_kinds(old, new, {"content": ["content_hash"], "lineage": ["parse_fp"], "routing": ["publication_id"]})


# --- chunking and embedding ---


#: Two ends of sentences: parts between marks, those after an abbreviation joined to the next one.
SENTENCES = r"""p AS (SELECT doc_id, unnest(ps) AS part, unnest(range(len(ps))) AS i FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?]["''”’)\]]?)(\s+)(["''“‘(\[]?[A-Z0-9])', '\1' || chr(1) || '\2\3', 'g'), chr(1)) AS ps FROM documents)),
f AS (SELECT *, regexp_matches(part, '(?i)(?:^|[^A-Za-z.])\.*(?:al|approx|cf|dr|e\.g|eg|esp|etc|fig|i\.e|ie|inc|jr|ltd|mr|mrs|ms|no|pp|prof|sr|st|vs|vol|[A-Za-z])\.*[.!?]["''”’)\]]?$') AS goes_on FROM p),
g AS (SELECT *, coalesce(sum((NOT goes_on)::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM f),
s AS (SELECT doc_id, n, regexp_replace(string_agg(part, '' ORDER BY i), '^\s+', '') AS sentence FROM g GROUP BY ALL)"""


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, max(length(sentence)) AS longest, md5(string_agg(sentence, chr(10) ORDER BY n)) AS digest FROM s WHERE sentence <> '' GROUP BY doc_id")
def chk02_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-02: the sentences of every whole text, in expressions alone."""
    d = fx.dealt(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))
    # A text has sentences if it has more than white space; asked of the sentences, that would cut every text twice.
    cut = d.where(F.rlike("text", F.lit(rf"[^\s{X.MARK}]"))).select("doc_id", X.sentences(F.col("text")).alias("s"))
    longest = F.array_max(F.transform("s", lambda x: F.length(x))).cast("long")
    return cut.select("doc_id", F.size("s").cast("long").alias("n"), longest.alias("longest"), F.md5(F.array_join("s", "\n")).alias("digest"))


#: Lines as blocks, those of one token as headings; units of 40 tokens: lines, else sentences, else whole words; then the
#: groups that fill the budget, and short tails joined to the group before, both row by row.
PLAN = r"""b AS (SELECT doc_id, i AS position, t, len(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(regexp_replace(t, '\s+', ' ', 'g')) <> ''),
k AS (SELECT *, n > 1 OR NOT bool_or(n > 1) OVER (PARTITION BY doc_id) AS body FROM b),
o AS (SELECT *, coalesce(lag(body) OVER (PARTITION BY doc_id ORDER BY position), false) = false AS opens FROM k QUALIFY body),
long AS (SELECT doc_id, position, string_split(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '([.!?]["''”’)\]]?)(\s+)(["''“‘(\[]?[A-Z0-9])', '\1' || chr(1) || '\2\3', 'g'), chr(1)) AS ps FROM o WHERE n > 40),
p AS (SELECT doc_id, position, unnest(ps) AS part, unnest(range(len(ps))) AS i FROM long),
f AS (SELECT *, regexp_matches(part, '(?i)(?:^|[^A-Za-z.])\.*(?:al|approx|cf|dr|e\.g|eg|esp|etc|fig|i\.e|ie|inc|jr|ltd|mr|mrs|ms|no|pp|prof|sr|st|vs|vol|[A-Za-z])\.*[.!?]["''”’)\]]?$') AS goes_on FROM p),
g AS (SELECT *, coalesce(sum((NOT goes_on)::INTEGER) OVER (PARTITION BY doc_id, position ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM f),
s AS (SELECT doc_id, position, s, t, len(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM (SELECT doc_id, position, s, regexp_replace(string_agg(part, '' ORDER BY i), '^\s+', '') AS t FROM g GROUP BY ALL) WHERE t <> ''),
ws AS (SELECT doc_id, position, s, w, len(regexp_extract_all(w, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n, row_number() OVER (PARTITION BY doc_id, position, s ORDER BY i) AS i FROM (SELECT doc_id, position, s, unnest(string_split_regex(t, '\s+')) AS w, generate_subscripts(string_split_regex(t, '\s+'), 1) AS i FROM s WHERE n > 40) WHERE w <> ''),
h AS (SELECT doc_id, position, s, i, w, n AS used, 1 AS g FROM ws WHERE i = 1 UNION ALL SELECT ws.doc_id, ws.position, ws.s, ws.i, ws.w, CASE WHEN used + ws.n > 40 THEN ws.n ELSE used + ws.n END, CASE WHEN used + ws.n > 40 THEN h.g + 1 ELSE h.g END FROM h JOIN ws ON ws.doc_id = h.doc_id AND ws.position = h.position AND ws.s = h.s AND ws.i = h.i + 1),
parts AS (SELECT doc_id, position, 0 AS s, 0 AS g, t, n FROM o WHERE n <= 40 UNION ALL SELECT doc_id, position, s, 0, t, n FROM s WHERE n <= 40 UNION ALL SELECT doc_id, position, s, g, string_agg(w, ' ' ORDER BY i), max(used) FROM h GROUP BY ALL),
u AS (SELECT doc_id, parts.t, parts.n, opens AND row_number() OVER (PARTITION BY doc_id, position ORDER BY s, g) = 1 AS opens, row_number() OVER (PARTITION BY doc_id ORDER BY position, s, g) AS i FROM parts JOIN o USING (doc_id, position)),
a AS (SELECT doc_id, i, n AS used, 1 AS g FROM u WHERE i = 1 UNION ALL SELECT u.doc_id, u.i, CASE WHEN u.opens OR used + u.n > 40 THEN u.n ELSE used + u.n END, CASE WHEN u.opens OR used + u.n > 40 THEN g + 1 ELSE g END FROM a JOIN u ON u.doc_id = a.doc_id AND u.i = a.i + 1),
gs AS (SELECT doc_id, g, sum(n) AS n, bool_or(opens) AS opens FROM a JOIN u USING (doc_id, i) GROUP BY ALL),
m AS (SELECT doc_id, g, n AS used, 0 AS c FROM gs WHERE g = 1 UNION ALL SELECT gs.doc_id, gs.g, CASE WHEN NOT gs.opens AND gs.n < 12 AND used + gs.n <= 40 THEN used + gs.n ELSE gs.n END, CASE WHEN NOT gs.opens AND gs.n < 12 AND used + gs.n <= 40 THEN c ELSE c + 1 END FROM m JOIN gs ON gs.doc_id = m.doc_id AND gs.g = m.g + 1)"""


@query(f"WITH RECURSIVE {PLAN} SELECT doc_id, c::INTEGER AS position, sum(u.n)::INTEGER AS token_count, md5(string_agg(u.t, chr(10) || chr(10) ORDER BY u.i)) AS digest FROM m JOIN a USING (doc_id, g) JOIN u USING (doc_id, i) GROUP BY doc_id, c")
def chk06_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-02, 04, 05, 06, 07: whole texts in chunks of forty tokens, as a plan of expressions."""
    d = fx.dealt(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("position", "text")).withColumn("tokens", chunk_plan.token_count(F.col("text")))
    kind = F.when(F.col("tokens") > 1, "prose").otherwise("heading")
    blocks = lines.select("document_id", "position", kind.alias("kind"), F.array().cast("array<string>").alias("path"), "text", F.lit(0).alias("header_rows"), "tokens")
    made = chunk_plan.chunks(blocks, chunking.Budget(50, 0, 12, 10))
    return made.select(F.col("document_id").alias("doc_id"), "position", "token_count", F.md5("text").alias("digest"))


@query("SELECT s_suppkey AS k, 4 AS n, 'Dr. ' || s_name || ' left.' AS second FROM supplier")
def chk05_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-05: sentences end at marks, but not after a title or inside a number."""
    made = X.sentences(F.concat(F.lit("See "), "n", F.lit(" now. Dr. "), "n", F.lit(" left. Was it 3.5 then? Yes.")))
    return _suppliers(spark, sf_dir).select("k", made.alias("s")).select("k", F.size("s").alias("n"), F.get("s", F.lit(1)).alias("second"))


@query("SELECT s_suppkey AS k, least(s_suppkey % 40 + 1, 20) AS words FROM supplier")
def chk04_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-04: as much of a text as a budget takes, by whole words."""

    @F.pandas_udf("int")
    def words(n: pd.Series) -> pd.Series:
        return n.map(lambda v: len(chunking.hard_split(" ".join(["word"] * (v % 40 + 1)), 20)[0].split()))

    return _suppliers(spark, sf_dir).select("k", words("k").alias("words"))


@query("SELECT s_suppkey AS k, s_name || ' > Part > ' || s_suppkey AS crumbs, s_name || ' > … > ' || s_suppkey AS short FROM supplier")
def chk10_breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-10: parts in a row, repeats dropped; what is too long loses its middle."""

    @F.pandas_udf("string")
    def crumbs(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chunking.breadcrumb([a, a.upper(), "Part", "", str(b)], 50) for a, b in zip(n, k, strict=True)])

    @F.pandas_udf("string")
    def short(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chunking.breadcrumb([a, "a long part of many words", "and one more of them", str(b)], 8) for a, b in zip(n, k, strict=True)])

    return _suppliers(spark, sf_dir).select("k", crumbs("n", "k").alias("crumbs"), short("n", "k").alias("short"))


def _chunked(spark: SparkSession, sf_dir: str, blocks: str, budget: chunking.Budget) -> DataFrame:
    """Chunks of the blocks that an expression over ``k, n`` makes."""
    kind = "array<struct<kind:string,text:string,heading_path:array<string>,lang:string,start:int,end:int,anchor:string,header_rows:int>>"
    rows = _suppliers(spark, sf_dir).select(F.col("k").alias("document_id"), F.lit("").alias("title"), F.expr(blocks).cast(kind).alias("blocks"))
    return chunking.chunked(rows, budget)


def _block(kind: str, text: str, path: str = "array('H')", rows: int = 0) -> str:
    return f"named_struct('kind', '{kind}', 'text', {text}, 'heading_path', {path}, 'lang', cast(null as string), 'start', 1, 'end', 2, 'anchor', '', 'header_rows', {rows})"


@query("SELECT s_suppkey AS document_id, unnest([0, 1, 2])::INTEGER AS position, unnest(['One ' || s_suppkey || '.' || chr(10) || chr(10) || 'Two ' || s_suppkey || '.', 'x = ' || s_suppkey, 'Three.']) AS text, unnest(['prose', 'code', 'prose']) AS kind FROM supplier")
def chk06_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-06, CHK-07: prose under one heading goes together, code stands alone."""
    blocks = f"array({_block('heading', repr('H'))}, {_block('prose', 'concat(\"One \", k, \".\")')}, {_block('prose', 'concat(\"Two \", k, \".\")')}, {_block('code', 'concat(\"x = \", k)')}, {_block('prose', '\"Three.\"')})"
    return _chunked(spark, sf_dir, blocks, chunking.Budget(64, 0, 8, 16)).select("document_id", "position", "text", "kind")


@query("SELECT s_suppkey AS document_id, i::INTEGER AS position, 'h | ' || s_suppkey || chr(10) || list_aggregate(list_transform(range(i * 4, i * 4 + 4), lambda r: 'row ' || r || ' | ' || r), 'string_agg', chr(10)) AS text FROM supplier, range(3) t(i)")
def chk02_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-02: a tall table in parts of whole rows, each under the repeated header."""
    rows = "array_join(transform(sequence(0, 11), r -> concat('row ', r, ' | ', r)), '\\n')"
    blocks = f"array({_block('table', f'concat(\"h | \", k, \"\\n\", {rows})', rows=1)})"
    # A row takes four tokens, the header three; four rows fit beside it.
    return _chunked(spark, sf_dir, blocks, chunking.Budget(38, 0, 8, 16)).select("document_id", "position", "text")


@query("SELECT s_suppkey AS document_id, unnest([0, 1])::INTEGER AS position, unnest(['First ' || s_suppkey || ' of all. Then the tail comes.', 'Then the tail comes.' || chr(10) || chr(10) || 'Second one has words. And more of them here.']) AS text FROM supplier")
def chk08_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-08: a chunk begins with the last sentences of the one before, as far as they fit."""
    blocks = f"array({_block('prose', 'concat(\"First \", k, \" of all. Then the tail comes.\")')}, {_block('prose', '\"Second one has words. And more of them here.\"')})"
    return _chunked(spark, sf_dir, blocks, chunking.Budget(33, 5, 2, 16)).select("document_id", "position", "text")


@query("SELECT o_orderkey, greatest(1, least(64, 16384 // greatest(1, o_orderkey % 9000))) AS n FROM orders")
def emb05_batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", embedding.batch_sizes(F.col("o_orderkey") % 9000).alias("n"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), t AS (SELECT vec_id, unnest(range(1, 5)) AS d, e FROM v)
SELECT vec_id AS chunk_id, d, round(e[d], 5) AS cls, round(list_sum(list_transform(range(0, 12), lambda k: e[4 * k + d])) / 12, 5) + 0.0 AS mean, round(e[44 + d], 5) AS last FROM t""")
def emb01_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-01: a vector as sixteen tokens of four dimensions, of which the last four are padding."""
    import numpy as np

    def pool(how: str):
        @F.pandas_udf("array<double>")
        def run(v: pd.Series) -> pd.Series:
            states = np.array(list(v), np.float64).reshape(len(v), 16, 4)
            return pd.Series(list(embedding.pooled(states, np.array([[1] * 12 + [0] * 4] * len(v)), how)))

        return run

    hows = ("cls", "mean", "last")
    made = fx.vectors(spark, sf_dir).select("chunk_id", F.posexplode(F.arrays_zip(*[pool(h)("vector").alias(h) for h in hows])).alias("d", "x"))
    return made.select("chunk_id", (F.col("d") + 1).alias("d"), *[(F.round(F.col("x")[h], 5) + 0.0).alias(h) for h in hows])


@query("SELECT vec_id AS chunk_id, 1.0 AS norm, true AS stable FROM embeddings")
def emb03_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB-03: a vector of any length as it is stored; what is stored stays as it is."""
    import numpy as np

    @F.pandas_udf("norm double, stable boolean")
    def run(v: pd.Series) -> pd.DataFrame:
        once = [embedding.canonical(3 * np.array(x)) for x in v]
        return pd.DataFrame({"norm": [round(float(np.linalg.norm(x.astype(np.float64))), 6) for x in once], "stable": [bool((embedding.canonical(x) == x).all()) for x in once]})

    return fx.vectors(spark, sf_dir).select("chunk_id", run("vector").alias("r")).select("chunk_id", "r.norm", "r.stable")


# --- text ---


@query(r"SELECT p_partkey, CASE WHEN length(regexp_replace(p_name, '[^A-Z0-9]', '', 'g')) >= 3 THEN regexp_replace(p_name, '[^A-Z0-9]', '', 'g') END AS skeleton FROM (SELECT p_partkey, p_brand || ' ' || p_type AS p_name FROM part)")
def scl_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_partkey", X.initial_skeleton(F.concat_ws(" ", "p_brand", "p_type")).alias("skeleton"))


@query("SELECT s_suppkey AS k, s_name AS heading, CASE WHEN s_suppkey % 3 <> 2 THEN 'sells ' || s_suppkey || ': all' END AS description FROM supplier")
def scl_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: where a heading ends and its description begins."""
    k = F.col("k")
    said = F.concat(F.lit("sells "), k, F.lit(": all"))
    line = F.when(k % 3 == 0, F.concat("n", F.lit(" — "), said)).when(k % 3 == 1, F.concat("n", F.lit(": "), said)).otherwise(F.concat(F.lit("  "), "n"))
    return _suppliers(spark, sf_dir).select("k", A.heading_and_description(line).alias("x")).select("k", "x.heading", "x.description")


@query("SELECT s_suppkey AS k, 'Mail [email] or [ipv6-address], from [ip-address] by [credit-card] of ' || s_suppkey AS text, '{\"credit-card\":1,\"email\":1,\"ip-address\":1,\"ipv6-address\":1}' AS counts FROM supplier")
def red01_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RED-01: each built-in kind once."""
    k = F.col("k")
    rows = _suppliers(spark, sf_dir).select("k", F.concat(F.lit("Mail a"), k, F.lit("@mail.example.org or fe80::1:"), F.lower(F.hex(k % 4096)), F.lit(", from 10.0."), k % 256, F.lit(".7 by 4111 1111 1111 1111 of "), k).alias("text"))
    out = A.redacted(rows, "k", "text")
    return out.select("k", "text", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("counts")))).alias("counts"))


@query("SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '[0-9@]|::')")
def red01_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RED-01: texts that can hold none of the kinds come out as they are."""
    out = A.redacted(fx.table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.where("size(counts) = 0 and not text rlike '[0-9@]|::'").select("doc_id", "text")


@query("SELECT s_suppkey AS k, 'The [ticket] of [ticket] is closed' AS text FROM supplier")
def red02_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RED-02: a pattern of one's own beside the built-in ones."""
    rows = _suppliers(spark, sf_dir).select("k", F.concat(F.lit("The TK-"), F.col("k"), F.lit("x of TK-"), F.col("k") + 1, F.lit("x is closed")).alias("text"))
    return A.redacted(rows, "k", "text", custom={"ticket": r"TK-\d+x"}).select("k", "text")


@query("SELECT s_suppkey AS k, 'Use ' || s_name || ' first' AS text, s_suppkey % 3 AS slot, CASE s_suppkey % 3 WHEN 0 THEN 'bound' WHEN 1 THEN 'located' ELSE 'resolved' END AS rung FROM supplier")
def cit03_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIT-03, CIT-04: how far each citation is proved, and the answer with its markers taken out of force."""
    k = F.col("k")
    s = _suppliers(spark, sf_dir)
    bindings = s.select(k.alias("answer_id"), (k % 3).alias("slot"), F.concat(F.lit("c"), k).alias("chunk_id"), F.lit("bound").alias("outcome"))
    passages = s.select(F.concat(F.lit("c"), k).alias("chunk_id"), F.concat(F.lit("Use  "), "n", F.lit(" First")).alias("text"))
    anchors = s.select(F.concat(F.lit("c"), k).alias("chunk_id"), F.when(k % 3 != 0, "line:1-2").alias("anchor"), F.when(k % 3 == 1, "other").otherwise(F.concat(F.lit("then use "), "n", F.lit(" first of all"))).alias("resolved_text"))
    rungs = A.verified(bindings, passages, anchors)
    return rungs.join(s, rungs.answer_id == s.k).select("k", F.concat(F.lit("Use "), "n", F.lit(" first")).alias("text"), "slot", "rung")


@query("SELECT doc_id AS document_id FROM documents WHERE doc_id % 3 <> 1")
def grd10_undetected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-10: documents whose glossary was detected by other rules, or not at all."""
    now, before = A.lineage({"forms": "2"}, {"engine": "1"}), A.lineage({"forms": "1"}, {"engine": "1"})
    i = F.col("document_id")
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")).withColumn("glossary_fp", F.when(i % 3 == 1, now).when(i % 3 == 2, before))
    return A.undetected(d, now).select("document_id")


# --- evaluation, retrieval, streams ---


@query("SELECT o_orderkey AS query_id, concat_ws('+', CASE WHEN o_orderkey % 2 = 0 THEN 'degraded_leg' END, CASE WHEN o_orderkey % 3 = 0 THEN 'cached' END, CASE WHEN o_orderkey % 5 = 0 THEN 'exhausted' END) AS reasons FROM orders")
def grd09_incomparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = fx.table(spark, sf_dir, "orders").select(k.alias("query_id"), (k % 2 == 0).alias("degraded"), (k % 3 == 0).alias("cached"), F.when(k % 5 == 0, "exhausted_corpus").otherwise("satisfied").alias("outcome"))
    return evaluation.incomparable(runs).select("query_id", F.array_join("reasons", "+").alias("reasons"))


@query("SELECT vec_id AS query_id, vec_id AS first, 'exact' AS system FROM embeddings WHERE vec_id % 50 = 0")
def eva07_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVA-07: a search as a system under evaluation."""
    run = evaluation.as_system("exact", lambda q: R.dense_batched(fx.vectors(spark, sf_dir), q, 3), {"k": 3})
    return run(fx.vector_queries(spark, sf_dir)).where("rank = 1").select("query_id", F.col("chunk_id").alias("first"), "system")


@query("SELECT 'dense' AS stage, 0 AS place, 8 * count(*) AS rows FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT 'cut', 1, 3 * count(*) FROM embeddings WHERE vec_id % 50 = 0")
def ret15_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-15: stages in a row, with what each made."""
    stages = [("dense", lambda q: R.dense_batched(fx.vectors(spark, sf_dir), q, 8)), ("cut", lambda c: R.top_k(c.drop("rank"), 3))]
    _, spans = R.traced(stages, fx.vector_queries(spark, sf_dir))
    return spans.select("stage", "place", "rows")


@query("SELECT user_id AS path, arg_max(event_type, event_id) AS change FROM events WHERE user_id % 7 <> 0 GROUP BY 1 HAVING arg_max(event_type, event_id) = 'deleted' OR user_id % 2 = 0")
def str05_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: changes without ignored paths and without files that have vanished since."""
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("change"), F.col("event_id").alias("seq"))
    present = e.where("path % 2 = 0").select("path")
    return watch.settled(watch.coalesced(e), F.col("path") % 7 == 0, present).select("path", "change")
