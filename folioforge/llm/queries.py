"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import apportion_mix, chosen_path, chunk_dedup, fill_middle, flac_media, lang_fusion, periodic_runs, pfor_tokens, pii_crf, residual_packing, simhash_trie, url_templates, zstd_toxicity
from folioforge.llm.common import WORD, table


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor_tokens.read_files(pfor_tokens.write_files(table(spark, sf_dir, "documents"), TOKENIZER))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.groups(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is of the document whose id ends its path; that document's labels are the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_templates.path_of(F.col("url")), "([0-9]{1,18})[^/0-9]*/?$", 1)
    named = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = F.when(F.coalesce("toxic", F.lit(0)) + (1 - F.coalesce("quality", F.lit(1))) > 0, 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    return url_templates.judged(pages, named.join(labels, "doc_id").select("page_id", "bad"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.components(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> tuple:
    """Fitted on the declared languages of three rows in four; the others, of crc32(doc_id) mod 4 = 2, are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return lang_fusion.train(docs.where(~held_out), "lang", "doc_id", "text")


def documents_language(docs: DataFrame) -> dict:
    """The model and the evidence of ``documents``: their declared language, their source as host."""
    return {"model": language_model(docs), "declared": F.col("lang"), "host": F.col("source")}


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_fusion.fused(docs, "doc_id", "text", **documents_language(docs))


def op5_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages: declared in their markup, by suffix and host of their address."""
    model = language_model(table(spark, sf_dir, "documents"))
    shown = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z]+)", 1))
    host = url_templates.host_of(F.col("url"))
    none = lambda c: F.when(c != "", c)
    pages = table(spark, sf_dir, "pages").select("page_id", shown.alias("text"), none(declared).alias("declared"), none(host).alias("host"))
    return lang_fusion.fused(pages, "page_id", "text", model, F.col("declared"), none(F.regexp_extract("host", r"\.([a-z]+)$", 1)), F.col("host"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.packed(table(spark, sf_dir, "documents"), TOKENIZER)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.found(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is never held out, and no label is its."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = zstd_toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    scores = zstd_toxicity.scored(docs, model)
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion_mix.shares(table(spark, sf_dir, "documents"))


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_media.read_back(flac_media.media_table(table(spark, sf_dir, "documents")))


def op10_flac_media_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written streams as a written table of PCM blocks, one row per block with its sample offset."""
    blocks = flac_media.pcm_blocks(flac_media.media_table(table(spark, sf_dir, "documents")))
    return blocks.select("doc_id", "block", "first_sample", "n_samples", F.crc32("pcm").alias("pcm_crc32"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.components(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs and the texts restored from them, as digests."""
    made = fill_middle.transformed(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts, by a hash of their ids, end in repeats of a stretch of theirs."""
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    sized = split.withColumn("start", F.when(F.size("words") > 0, F.col("g") % F.size("words")).cast("int"))
    period = (1 + F.floor((F.size("words") - F.col("start")) / (3 + F.col("g") % 8))).cast("int")
    return sized.select("doc_id", F.when(F.col("start").isNull(), F.col("text")).otherwise(periodic_runs.made_periodic(F.col("text"), F.col("words"), F.col("start"), period)).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.found(with_repeats(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_token_files, op2_exact_dedup, op3_url_filter, op4_near_dedup, op5_language_id, op5_language_id_pages, op6_pack_sequences, op7_personal_data, op8_toxicity, op9_mix_sources, op10_flac_media, op10_flac_media_pcm, op11_simhash_dedup, op12_fill_middle, op13_periodic_runs)}
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The other queries depend on other hashes, codecs, tokenizers or trained models, and are tested by brute force.
SQL: dict[str, str] = {
    "op2_exact_dedup": f"""WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op4_near_dedup": rf"""WITH RECURSIVE o AS (SELECT doc_id, min(coalesce(text, '')) AS text FROM documents GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM o),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op12_fill_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
r AS (SELECT *, len(u) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
 least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM h),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    # crc32 by bytes (a number from 0) and shifts (-1); matches of each lag by a self-join, islands by row numbers, the least period of each stretch.
    "op13_periodic_runs": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END) END)) AS h FROM documents),
e AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
r AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END) AS w FROM f),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
k AS (SELECT doc_id, start, length, min(q) AS period FROM l GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM k GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM k),
c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM r ANTI JOIN g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN (FROM b WHERE place = 1) b USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
