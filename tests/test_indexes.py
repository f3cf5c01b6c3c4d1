"""Passages, digest trees, includes, traces, bitmaps, ranges and the vector store against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import anchors, bitmaps, evaluation, includes, passages, trace, vector_store


def test_passages_are_found_as_contains_finds_them(spark):
    rng = random.Random(6)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [text(rng.choice([0, 1, 5, 60, 400]), rng.choice(["ab", "abcdé日 ", "xyz\n"])) for _ in range(120)] + [None, "ab" * 3000]
    asked = [t[i : i + n] for t in texts[:80] if t for n in (1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 31, 40, 100, 256) for i in [rng.randrange(max(1, len(t) - n + 1))]]
    asked += ["nowhere at all", "", None, "ab" * 1500, "é", "日", "aab"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3)
    p = spark.createDataFrame(list(enumerate(asked)), "item long, text string").repartition(3)
    found = passages.occurrences(d, p, "doc", "text", "item", "text")
    want = {(i, j) for i, a in enumerate(asked) if a for j, t in enumerate(texts) if t is not None and a in t}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_passages_with_too_many_anchors_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(passages, "MOST_KNOWN", 2)
    d = spark.createDataFrame([(1, "one two three four"), (2, "five six seven")], "doc long, text string")
    p = spark.createDataFrame([("a", "two three"), ("b", "six"), ("c", "eight")], "item string, text string")
    assert sorted(map(tuple, passages.occurrences(d, p, "doc", "text", "item", "text").collect())) == [("a", 1), ("b", 2)]


def test_anchors_of_a_part_are_anchors_of_the_whole():
    rng = np.random.default_rng(2)
    for scale in (1, 2, 3, 8, 40, 64):
        gram, window = passages.shape(scale)
        assert gram + window - 1 <= scale
        whole = rng.integers(0, 3, 500).astype(np.uint8)
        for _ in range(30):
            a = int(rng.integers(0, 400))
            part = whole[a : a + scale + int(rng.integers(0, 40))]
            if len(part) >= scale:
                assert len(made := passages.anchors(part, gram, window)) and np.isin(made, passages.anchors(whole, gram, window)).all()


@pytest.mark.parametrize("digits", [0, 1, 3, None])
def test_disagreement_is_a_full_outer_join(spark, digits):
    rng = random.Random(3)
    left = {i: str(rng.randrange(50)) for i in range(700) if rng.random() < 0.98}
    right = {i: (v if rng.random() < 0.98 else "other") for i, v in left.items() if rng.random() < 0.99} | {1000 + i: "n" for i in range(5)}
    a, b = (spark.createDataFrame(list(x.items()), "document_id long, content_hash string").repartition(3) for x in (left, right))
    got = {r.document_id: r.state for r in evaluation.disagreement(a, b, digits).collect()}
    want = {i: "new" if i not in left else "missing" if i not in right else "changed" for i in left.keys() | right.keys() if left.get(i) != right.get(i)}
    assert got == want and set(want.values()) == {"new", "missing", "changed"}
    assert evaluation.disagreement(a, a, digits).count() == 0
    assert evaluation.disagreement(a, a.limit(0), digits).count() == len(left)


def test_only_nodes_that_differ_are_descended(spark):
    a = spark.range(2000).select(F.col("id").alias("document_id"), F.lit("x").alias("content_hash"))
    b = a.withColumn("content_hash", F.when(F.col("document_id") == 77, "y").otherwise("x"))
    trees = [evaluation.merkle_tree(t, 3) for t in (a, b)]
    leaves = evaluation.unequal_leaves(*trees).collect()
    assert len(leaves) == 1 and leaves[0].level == 3
    assert evaluation.corpus_digest(a).first().digest != evaluation.corpus_digest(b).first().digest
    assert trees[0].where("level = 0").first().n == 2000


def test_includes_are_spliced_in_place(spark):
    m = lambda p: "{{include:" + p + "}}"
    rows = [("a", f"1{m('b')}2{m('c')}3"), ("b", f"<{m('c')}>"), ("c", "c"), ("d", f"d{m('d')}"), ("e", f"{m('f')}"), ("f", f"x{m('e')}y"), ("g", f"{m('zz')}{m('zz')}!"), ("h", f"{m('a')}"), ("n", None), ("o", "")]
    pages = spark.createDataFrame(rows, "page string, body string").repartition(2)
    body, gaps = includes.spliced(pages, "page", "body", 5)
    assert {r.page: r.body for r in body.collect()} == {"a": "1<c>2c3", "b": "<c>", "c": "c", "d": "d", "e": "xy", "f": "xy", "g": "!", "h": "1<c>2c3", "o": ""}
    assert {tuple(r) for r in gaps.collect()} == {("d", "d", "cycle", 1), ("e", "e", "cycle", 1), ("f", "f", "cycle", 1), ("g", "zz", "missing", 2)}
    body, gaps = includes.spliced(pages, "page", "body", 1)
    assert {r.page: r.body for r in body.collect()}["h"] == "123" and ("h", "b", "too_deep", 1) in {tuple(r) for r in gaps.collect()}
    body, gaps = includes.spliced(pages.limit(0), "page", "body")
    assert body.count() == 0 and gaps.count() == 0


def test_a_trace_measures_the_action_it_is_in(spark):
    t = trace.Trace(spark)
    rows = t.watch("all", spark.range(100).select(F.col("id"), (F.col("id") / 2).alias("score")))
    some = t.watch("some", rows.where("id >= 40").withColumn("score", F.when(F.col("id") % 2 == 0, F.col("score"))))
    with pytest.raises(ValueError):
        t.watch("all", some)
    assert t.watch("none", some.where("id < 0"), None).count() == 0
    assert [tuple(r) for r in t.report().collect()] == [(0, "all", 100, 100, 0.0, 49.5), (1, "some", 60, 30, 20.0, 49.0), (2, "none", 0, 0, None, None)]


def test_bitmaps_are_the_sets_they_stand_for(spark):
    rng = random.Random(4)
    rows = [(d, v, rng.randrange(1, 200_000)) for d, values in (("c", "xyz"), ("t", "pq")) for v in values for _ in range(4000)]
    rows += [("c", "x", n) for n in (1, 32_768, 32_769, 65_536, None)] + rows[:50]
    table = spark.createDataFrame(rows, "dimension string, value string, number long").repartition(3)
    sets = {}
    for d, v, n in rows:
        if n is not None:
            sets.setdefault((d, v), set()).add(n)
    built = bitmaps.built(table)
    assert {(r.dimension, r.value): r.n_documents for r in bitmaps.counted(built, "dimension", "value").collect()} == {k: len(s) for k, s in sets.items()}
    got = {}
    for r in bitmaps.numbers(built, "dimension", "value").collect():
        got.setdefault((r.dimension, r.value), set()).add(r.number)
    assert got == sets
    want = (sets["c", "x"] | sets["c", "y"]) & (sets["t", "p"] | sets["t", "q"])
    scope = bitmaps.scoped(built, {"c": ("x", "y"), "t": ("p", "q")})
    assert {r.number for r in bitmaps.numbers(scope).collect()} == want and bitmaps.counted(scope).first().n_documents == len(want)
    assert bitmaps.counted(bitmaps.scoped(built, {"c": ("x",), "t": ("no",)})).first().n_documents == 0
    halves = bitmaps.merged(bitmaps.built(table.where("number % 2 = 0")), bitmaps.built(table.where("number % 2 = 1")))
    assert {r.number for r in bitmaps.numbers(bitmaps.scoped(halves, {"t": ("p",)})).collect()} == sets["t", "p"]


def test_anchors_lie_inside_blocks(spark):
    rng = random.Random(5)
    a = [(d, s, s + rng.choice([0, 1, 5, 40])) for d in "ab" for s in (rng.randrange(300) for _ in range(60))] + [("a", 7, 3), ("b", 1, 10_000)]
    b = [(d, s, s + rng.choice([0, 1, 2, 7, 8, 9, 100, 1000])) for d in "abc" for s in (rng.randrange(300) for _ in range(60))] + [("a", 0, 1 << 40), ("a", 9, 2)]
    found = anchors.inside(spark.createDataFrame(a, "document_id string, start long, end long").dropDuplicates(), spark.createDataFrame(b, "document_id string, start long, end long").dropDuplicates())
    want = {(d, s, e, x, y) for d, s, e in set(a) for f, x, y in set(b) if d == f and x <= s <= e <= y}
    got = [(r.document_id, r.start, r.end, r.block_start, r.block_end) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_stored_vectors_stay_where_they_are(spark, tmp_path):
    store = vector_store.create(spark, "vectors_of_test", f"{tmp_path}/v", 4)
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return np.array([[len(t), 1.0] for t in texts], np.float32)

    rows = spark.createDataFrame([(i, f"i{i % 7}", f"text {i % 7}") for i in range(20)] + [(99, "none", None)], "chunk_id long, identity string, embed_text string")
    first = store.embed_or_reuse(rows.where("chunk_id < 3"), embed).collect()
    assert {r.origin for r in first} == {"embedded"} and calls.value == 3
    again = {r.chunk_id: r for r in store.embed_or_reuse(rows, embed).collect()}
    assert calls.value == 7 and len(again) == 21 and store.table().count() == 7
    assert all((r.origin == "reused") == (i % 7 < 3 and i != 99) and (r.vector == [6.0, 1.0] if i != 99 else r.vector is None) for i, r in again.items())
    plan = store.found(rows)._jdf.queryExecution().executedPlan().toString()
    # The side of the join that is stored is read and sorted at most.
    stored = plan[plan.rindex("SortMergeJoin") :].split("+- ", 1)[1].rsplit("Exchange", 1)[-1]
    assert "Bucketed: true" in stored and plan.count("Exchange") == 1
    spark.sql("DROP TABLE vectors_of_test")


def test_digest_of_a_corpus_does_not_follow_its_size(spark):
    """Over 16,000 rows, where a tree of its own depth would have two digits."""
    docs = spark.range(17_000).select(F.col("id").alias("document_id"), F.md5(F.col("id").cast("string")).alias("content_hash"))
    groups: dict[str, list[str]] = {}
    for i in range(17_000):
        h = hashlib.md5(str(i).encode()).hexdigest()
        groups.setdefault(h[0], []).append(f"{i}\0{h}\n")
    leaves = [hashlib.sha256("".join(sorted(groups[p])).encode()).hexdigest() for p in sorted(groups)]
    row = evaluation.corpus_digest(docs).first()
    assert (row.digest, row.groups) == (hashlib.sha256("".join(leaves).encode()).hexdigest(), 16)
