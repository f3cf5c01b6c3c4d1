import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge import components
from folioforge.operators import ann, embedding, lifecycle, retrieval, store


def test_registry_and_container():
    r = components.defaults()
    assert r.names("embedder") == ["hashing"] and "html" in r.names("parser")
    c = components.Container(r, {"embedder": {"name": "hashing", "dim": 8}})
    assert c.get("embedder")(["a b"]).shape == (1, 8) and c.get("embedder") is c.get("embedder")
    for call in (lambda: r.make("embedder", "none"), lambda: c.get("reranker"), lambda: r.add("other", "x", int)):
        with pytest.raises(components.UnknownComponent):
            call()
    with pytest.raises(ValueError):
        r.add("embedder", "hashing", int)
    r.add("connector", "bad", lambda: object())
    with pytest.raises(TypeError):
        r.make("connector", "bad")


def test_hooks_run_around_a_stage(spark):
    class Adds(components.Hook):
        def __init__(self, n):
            self.n = n

        def before(self, stage, rows):
            return rows.withColumn("trail", F.concat("trail", F.lit(f"<{self.n}")))

        def after(self, stage, rows):
            return rows.withColumn("trail", F.concat("trail", F.lit(f"{self.n}>{stage}")))

    rows = spark.createDataFrame([("",)], "trail string")
    run = components.hooked("s", lambda d: d.withColumn("trail", F.concat("trail", F.lit("|"))), [Adds(1), components.Hook(), Adds(2)])
    assert run(rows).first()[0] == "<1<2|2>s1>s"


def test_index_recall_and_probes(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 16))
    rows = [(i, (middles[i % 20] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    v = spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 16)], "chunk_id long, vector array<float>").repartition(3)
    q = v.where("chunk_id % 50 = 0 and chunk_id < 9000").withColumnRenamed("chunk_id", "query_id")
    index = ann.build(v)
    assert len(index.centres) == int(1501**0.5) and index.table(spark).count() == 1500
    probes, got = ann.calibrated(spark, index, v.where("chunk_id < 9000"), q, 10)
    assert got >= 0.9 and probes < len(index.centres)
    exact = {(r.query_id, r.chunk_id) for r in retrieval.dense_batched(v.where("chunk_id < 9000"), q, 10).collect()}
    found = {(r.query_id, r.chunk_id) for r in ann.search(spark, index, q, 10, len(index.centres)).collect()}
    assert found == exact
    few = ann.search(spark, index, q, 10, 2)
    assert "PushedFilters: [In(part" in few._jdf.queryExecution().toString() or "part" in few._jdf.queryExecution().toString()
    assert ann.build(v).centres.tolist() == index.centres.tolist()  # the sample doesn't depend on the order of rows


def test_codes_reach_the_recall_they_are_asked_for(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 32))
    rows = [(f"c{i:04}", (middles[i % 12] + 0.8 * rng.normal(size=32)).tolist()) for i in range(1200)]
    rows += [(f"same{i:03}", [1.0] * 32) for i in range(500)] + [("none", None), ("zero", [0.0] * 32)]
    v = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(4)
    q = v.where("chunk_id rlike '^c.*[05]0$' or chunk_id = 'same007'").withColumnRenamed("chunk_id", "query_id")
    built = ann.build(v, sub_vectors=8)
    index = ann.opened(spark, built.path)
    assert (index.books == built.books).all() and index.rows == built.rows and index.books.shape == (8, 256, 4)
    assert index.table(spark).where("length(codes) <> 8").count() == 0 and index.table(spark).count() == 1700
    rerank, got = ann.calibrated_codes(spark, index, v.where("chunk_id <> 'none'"), q, 10, len(index.centres))
    assert got >= 0.9 and rerank * 10 < 400
    scan = ann.search_coded(spark, index, q, 10, 3)
    plan = scan._jdf.queryExecution().toString()
    assert "ReadSchema: struct<chunk_id:string,part:int,codes:binary>" in plan or "codes" in plan
    # Equal vectors tie by id, however many they are; and shares of the queries are passes of their own.
    want = {(r.query_id, r.chunk_id, r.rank) for r in retrieval.dense_batched(v.where("chunk_id <> 'none'"), q, 10).collect()}
    assert {(x, y) for x, y, _ in want if x == "same007"} == {("same007", f"same{i:03}") for i in range(10)}
    assert {(r.query_id, r.chunk_id, r.rank) for r in retrieval.dense_batched(v.where("chunk_id <> 'none'"), q, 10, most_queries=7).collect()} == want
    assert {(r.query_id, r.chunk_id, r.rank) for r in ann.search(spark, index, q, 10, len(index.centres), most_queries=5).collect()} == want
    deep = ann.search_coded(spark, index, q, 10, len(index.centres), 60, most_queries=9)
    assert {(r.query_id, r.chunk_id, r.rank) for r in deep.collect()} == want
    seen = v.where("chunk_id like 'same%'")
    assert {r.chunk_id for r in ann.search_coded(spark, index, q, 3, len(index.centres), 5, seen).collect()} == {"same000", "same001", "same002"}


def test_depth_of_codes_is_found_in_one_scan_and_moves_no_candidates(spark):
    """Vectors without clusters, whose codes say little: the depth that is found is the least of its kind, and a search
    sends on the rows it returns and no candidates."""
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(1500)], "chunk_id long, vector array<double>").repartition(3)
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    index = ann.build(v)
    exact = retrieval.dense_batched(v, q, 5).select("query_id", "chunk_id").cache()
    for least in (0.9, 1.0):
        rerank, got = ann.calibrated_codes(spark, index, v, q, 5, len(index.centres), least, most_queries=11)
        assert got >= least and ann.recall(ann.search_coded(spark, index, q, 5, len(index.centres), rerank), exact) == got
        assert rerank == 4 or ann.recall(ann.search_coded(spark, index, q, 5, len(index.centres), rerank // 2), exact) < least
    assert rerank * 5 > 100
    plan = ann.search_coded(spark, index, q, 5, len(index.centres), rerank)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1  # candidates aren't joined with their vectors


def test_equal_vectors_tie_whatever_stands_beside_them(spark):
    rng = np.random.default_rng(8)
    same = rng.normal(size=64).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=64).tolist()) for i in range(700)]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(5)
    q = v.where("chunk_id in (3, 333, 699)").withColumnRenamed("chunk_id", "query_id")
    for found in (retrieval.dense_batched(v, q, 7), retrieval.dense_exact(v, q, 7), retrieval.dense_exact(v, q, 7, 0.5)):
        assert {(r.chunk_id, r["rank"]) for r in found.collect()} == {(3 * i, i + 1) for i in range(7)}
    plan = retrieval.dense_exact(v, q, 7)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ranks_by_rounded_scores_keep_their_own(spark):
    c = spark.createDataFrame([(1, 5, 0.99156849991), (1, 4, 0.99156849989), (1, 3, 0.2)], "query_id long, chunk_id long, score double")
    got = {r.chunk_id: (r.score, r["rank"]) for r in retrieval.top_k(c, 2, digits=9).collect()}
    assert got == {4: (0.99156849989, 1), 5: (0.99156849991, 2)}
    assert {r.s for r in retrieval.top_k(c, 2, digits=9).select(F.round("score", 6).alias("s")).collect()} == {0.991568}


def test_a_task_keeps_the_best_rows_of_each_query():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    top, rows = retrieval.RunningTop(5, spare=50), []
    for _ in range(40):
        q, score = rng.integers(0, 7, 30), rng.integers(0, 9, 30) / 8
        ids = [f"i{int(x):04}" for x in rng.integers(0, 10_000, 30)]
        top.add(q, pa.array(ids), score)
        rows += list(zip(q.tolist(), (-score).tolist(), ids, strict=True))
        assert top.size < 200
    q, ids, score = top.rows()
    want = sorted(r for x in range(7) for r in sorted(r for r in rows if r[0] == x)[:5])
    assert sorted(zip(q.tolist(), (-score).tolist(), ids.to_pylist(), strict=True)) == want


def test_window_guard(spark):
    d = spark.createDataFrame([(5,), (90,)], "token_count int")
    embedding.require_within(d, 90)
    with pytest.raises(ValueError):
        embedding.require_within(d, 89)


def test_streamed_scan_holds_some_rows(spark):
    got = [len(part) for part in store.streamed(spark.range(25), 10)]
    assert got == [10, 10, 5]


def test_verified_manifests(spark):
    rows = spark.createDataFrame([(r, i, f"s{i}") for r in (1, 2, 3) for i in range(7)], "run_id int, ordinal int, source_id string")
    made = lifecycle.manifest(rows, F.col("source_id"), ["ordinal"], block=3)
    again = lifecycle.manifest(rows.where("run_id <> 3 and not (run_id = 2 and ordinal = 4)").repartition(4), F.col("source_id"), ["ordinal"], block=3)
    assert {r.run_id: r.verdict for r in lifecycle.verified(made, again).collect()} == {1: "verified", 2: "mismatch", 3: "missing"}


def test_closure_ends_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {(r.src, r.dst): (r.level, r.cycle) for r in store.include_closure(e, 9).collect()}
    assert got[("a", "a")] == (3, True) and got[("x", "y")] == (1, False) and len(got) == 10


def test_places_over_ranges(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "a int, b int").repartition(5)
    got = store.numbered(rows, ["a", "b"], "place")
    assert [r.place for r in got.orderBy("a").collect()] == list(range(1, 102)) and got.columns == ["a", "b", "place"]
    assert store.numbered(rows.limit(0), ["a"], "place").count() == 0
