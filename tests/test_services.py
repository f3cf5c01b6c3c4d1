"""Service operators on cases that the registered queries don't have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import analytics, chunking, conversations, corpus, evaluation, lifecycle, retrieval, store


def test_a_scorer_is_loaded_once_per_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda pairs: np.array([len(p) - len(q) for q, p in pairs], float)

    texts = spark.createDataFrame([(f"c{i:03}", "x" * (i % 50)) for i in range(200)], "chunk_id string, text string")
    found = spark.createDataFrame([(q, f"c{i:03}", i + 1) for q in (1, 2) for i in range(200)], "query_id int, chunk_id string, rank int").coalesce(1)
    queries = spark.createDataFrame([(1, "ab"), (2, None)], "query_id int, text string")
    out = retrieval.reranked(found, texts, queries, 60, load, at_once=7)
    rows = out.orderBy("query_id", "rank").collect()
    assert len(rows) == 120 and rows[0].chunk_id == "c049" and rows[0].score == 47.0 and rows[60].score == 49.0
    assert loads.value <= out.rdd.getNumPartitions() + 8
    with pytest.raises(Exception, match="one finite score"):
        retrieval.reranked(found, texts, queries, 5, lambda: lambda pairs: np.full(len(pairs), np.nan)).collect()


def test_rules_are_set_and_cleared_by_name(spark):
    rules = corpus.Rules()
    rules.set("Ａ  b", corpus.Filter(langs=("fr",)))
    rules.set("c", corpus.Filter(langs=("en",)))
    docs = spark.createDataFrame([(1, "fr"), (2, "en"), (3, None)], "document_id int, lang string")
    assert sorted(map(tuple, rules.members(docs).collect())) == [("a b", 1), ("c", 2)]
    assert rules.clear("a B") and not rules.clear("a b")
    assert [tuple(r) for r in rules.members(docs).collect()] == [("c", 2)] and rules.clear("C") and rules.members(docs).count() == 0
    for name, rule in ((" ", corpus.Filter(langs=("x",))), ("all", corpus.Filter())):
        with pytest.raises(ValueError):
            rules.set(name, rule)


def test_a_current_version_keeps_its_body(spark):
    rows = [("a", 1, 10, "x"), ("a", 2, 20, None), ("a", 3, 30, "z"), ("b", 1, 5, "y")]
    out = lifecycle.released(spark.createDataFrame(rows, "document_id string, version int, at int, blob string"), F.lit(100)).collect()
    assert {(r.document_id, r.version): (r.blob, r.released) for r in out} == {("a", 1): (None, True), ("a", 2): (None, False), ("a", 3): ("z", False), ("b", 1): ("y", False)}


def test_an_impact_frees_what_nothing_else_holds(spark):
    refs = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", None)], "blob string, run int")
    out = lifecycle.impacts(refs, spark.createDataFrame([("x", 10), ("y", 5)], "blob string, bytes long"), {"one": F.col("run") == 1, "all": F.lit(True), "none": F.lit(None).cast("boolean")}).collect()
    assert {r.action: (r.references, r.blobs, r.bytes) for r in out} == {"one": (2, 1, 5), "all": (4, 3, 15), "none": (0, 0, 0)}


def test_query_sets_are_checked(spark):
    good = [("a", "t", "2024-01-02T03:04:05.5+01:00"), ("b", "t", None), ("c", "t", "2024-01-02 03:04Z")]
    bad = [("a", "t", "2024-01-02"), ("a", "", "2024-01-02T03:04:05"), (None, None, "now")]
    sets = spark.createDataFrame([("good", 1, good), ("bad", 2, bad), ("none", None, [])], "name string, schema_version int, queries array<struct<id:string,text:string,created_at:string>>")
    got = sorted((r.name, str(r.id), r.problem) for r in evaluation.query_set_problems(sets).collect())
    assert got == sorted([("bad", "None", "schema_version"), ("none", "None", "schema_version"), ("bad", "a", "repeated_id"), ("bad", "a", "naive_time"), ("bad", "a", "naive_time"), ("bad", "a", "empty_text"), ("bad", "None", "missing_id"), ("bad", "None", "empty_text"), ("bad", "None", "naive_time")])


def test_shared_ends_and_canonical_json(spark):
    rows = [(["a", "b", "c"], ["a", "b", "d"]), (["a"], ["a", "b"]), ([], ["a"]), ([None, "x"], [None, "y"]), (["a", "b"], ["a", "b"]), (None, ["a"])]
    d = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    assert [tuple(r) for r in d.select(X.shared_prefix(F.col("a"), F.col("b")), X.shared_suffix(F.col("a"), F.col("b"))).collect()] == [(2, 0), (1, 0), (0, 0), (1, 0), (2, 2), (None, None)]
    one = spark.range(1).select(X.canonical_json({"b": F.lit('q"x'), "a": F.lit(1), "n": F.lit(None)}), X.canonical_json({"z": F.lit(None)})).first()
    assert tuple(one) == ('{"a":"1","b":"q\\"x"}', "{}")


def test_headings_define_only_what_they_spell(spark):
    rows = [("1", "SLA", "Service Level Agreement, which binds us"), ("2", "Ops > NOW", "The Network Operations Workspace holds the runbooks"), ("3", "RTO", "recovery time objective"), ("4", "Intro", "plain"), ("5", "API", ""), ("6", "TODO", "this is to do")]
    got = analytics.glossary(spark.createDataFrame(rows, "chunk_id string, heading_text string, text string")).where("form = 'heading'").collect()
    assert {(r.chunk_id, r.acronym, r.expansion) for r in got} == {("1", "SLA", "Service Level Agreement"), ("3", "RTO", "recovery time objective")}
    told = spark.createDataFrame([("API", "when enabled, it starts", "dash"), ("API", "IT for all", "dash"), ("WSE", "when something ends", "dash"), ("X1", "a b. c d", "colon"), ("X1", "one two three four five six seven eight nine ten eleven", "dash"), ("CPU", "central processor", "dash"), ("CPU", "central processor", "heading")], "a string, e string, f string")
    assert [r[0] for r in told.select(analytics.refusal(F.col("a"), F.col("e"), F.col("f"))).collect()] == ["refused_opening", None, None, "several_sentences", "too_long", None, "unproved_heading"]


def test_prompts_leave_out_empty_parts(spark):
    q = spark.createDataFrame([(1, "c", "what?"), (2, "d", "who?")], "query_id int, conv_id string, text string")
    p = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_id int, rank int, text string")
    m = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant", f"m{i}", 10) for i in range(4)], "conv_id string, turn int, role string, text string, tokens int")
    got = {r.query_id: r.prompt for r in conversations.prompts(q, p, m, "Be brief.", 25).collect()}
    assert got == {1: "Be brief.\n\nPassages:\n[1] first\n[2] second\n\nConversation:\nuser: m2\nassistant: m3\n\nQuestion: what?", 2: "Be brief.\n\nQuestion: who?"}


def test_blobs_are_got_by_their_addresses(spark):
    d = spark.createDataFrame([("aa",), ("bb",), ("aa",)], "text string")
    big = spark.createDataFrame([("zz",)], "text string").select(F.md5("text").alias("blob"))
    asked = spark.createDataFrame([("aa",), ("zz",), ("none",), ("aa",)], "t string").select(F.md5("t").alias("blob"))
    assert {(r.state, r.text) for r in store.gotten(asked, d, "text", big).collect()} == {("found", "aa"), ("omitted", None), ("unknown", None)}
    log = spark.createDataFrame([(i, i, "abc"[i % 3], f"u{i % 2}") for i in range(12)], "at int, id int, event string, actor string")
    page = store.audited(log, ("a", "b"), F.lit(2), "u0", 1, 2).collect()
    assert [(r.id, r.total) for r in page] == [(6, 3), (4, 3)]


def test_sentences_in_expressions_are_those_of_the_chunker(spark):
    import random

    rng = random.Random(1)
    parts = ["Dr. ", "A. ", "word. ", 'He said "no." ', "end! ", "3.5 ", "(Yes). ", "x ", "\n", "Vol. ", "etc. ", "x9a. ", "U.S. ", "é. "]
    texts = ["", " \n ", "no end", "See Dr. Smith. Was it 3.5? Yes."] + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.sentences(F.col("t")).alias("s")).collect()
    assert all(r.s == chunking.sentences(r.t.strip()) for r in rows)
    assert next(r.s for r in rows if r.t.startswith("See")) == ["See Dr. Smith.", "Was it 3.5?", "Yes."]
