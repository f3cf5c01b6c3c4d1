"""The kept index against the search that tokenises every chunk."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import inverted
from folioforge.operators.retrieval import Bm25


def _chunks(spark, n: int = 700):
    rng = random.Random(4)
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 60)}"  # noqa: E731  some terms everywhere, some once
    rows = [(f"c{i:04}", " ".join(word() for _ in range(rng.choice([0, 1, 6, 30]))), rng.choice(["", "w1 head", "w3"])) for i in range(n)]
    return spark.createDataFrame([*rows, ("empty", None, None), ("long", "w2 " * 5000, "w2")], "chunk_id string, text string, heading_text string").repartition(5)


QUERIES = [(1, "w0"), (2, "w0 w1 w2"), (3, "w59 w0"), (4, "w1 nowhere"), (5, ""), (6, None), (7, "w40 w3 w5"), (8, "W2 w2"), (9, "head w1"), (10, "w0 w1 w2 w3 w4 w5 w6 w7")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    chunks = _chunks(spark)
    patch = pytest.MonkeyPatch()
    patch.setattr(inverted, "BITS", 4)  # many blocks
    patch.setattr(inverted, "BEST", 2)
    yield chunks, inverted.build(chunks, f"file://{tmp_path_factory.mktemp('index')}/i")
    patch.undo()


def _rows(found):
    return sorted((tuple(r[c] for c in ("query_id", "chunk_id", "score")) for r in found.collect()))


@pytest.mark.parametrize("k", [1, 3, 25, None])
def test_index_finds_what_a_scan_finds(spark, built, k):
    chunks, index = built
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    want, got = Bm25().search(chunks, queries, k), inverted.search(index, queries, k)
    assert _rows(got) == _rows(want)
    assert {r[0] for r in _rows(got)} >= {1, 2, 8, 9}


def test_only_visible_chunks_are_ranked(spark, built):
    chunks, index = built
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    visible = chunks.where("chunk_id > 'c0400'")
    assert _rows(inverted.search(index, queries, 4, visible)) == _rows(Bm25().search(chunks, queries, 4, visible))


def test_blocks_are_of_bounded_length_and_cover_all_postings(spark, built):
    chunks, index = built
    postings = index.table("postings")
    assert postings.where("n > 16 or n <> size(at) or n <> size(tf) or n <> size(dl)").count() == 0
    assert index.n_chunks == chunks.count() == index.table("numbers").select("no").distinct().count()
    df = {r.term: r.df for r in index.table("lexicon").collect()}
    assert df["w0"] == chunks.where(r"text rlike '\\bw0\\b'").count()


def test_search_reads_no_text(spark, built):
    _, index = built
    files = inverted.search(index, spark.createDataFrame([(1, "w0 w1")], "query_id int, text string"), None).inputFiles()
    assert files and all("text" not in spark.read.parquet(f).columns for f in files)


def test_an_index_of_the_same_files_is_kept(spark, tmp_path):
    _chunks(spark, 20).write.parquet(f"{tmp_path}/c")
    read = lambda: spark.read.parquet(f"{tmp_path}/c")
    first = inverted.kept(read(), "a")
    assert inverted.kept(read(), "a") is first
    assert inverted.kept(read(), "b") is not first
    _chunks(spark, 21).write.mode("append").parquet(f"{tmp_path}/c")
    assert inverted.kept(read(), "a").n_chunks == first.n_chunks + 23


def test_index_of_nothing(spark, tmp_path):
    index = inverted.build(_chunks(spark, 5).limit(0), f"{tmp_path}/i")
    assert index.n_chunks == 0 and inverted.search(index, spark.createDataFrame([(1, "w0")], "query_id int, text string"), 3).count() == 0


def test_lists_are_made_where_the_chunks_are(spark, tmp_path):
    """Blocks that end inside a batch and lists that cross batches; no occurrence is shuffled, only rows of lists are."""
    rows = [(f"c{i:05}", " ".join(f"w{(i * j) % 97}" for j in range(1, 2 + i % 5)) if i % 7 else None, "h w1 w1") for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, heading_text string").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        index = inverted.build(chunks, f"file://{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict[tuple, list] = {}
    for c, text, heading in rows:
        words = (text or "").split()
        for t in {*words, "h", "w1"}:
            want[t, c] = [round(words.count(t) + 0.4 * heading.split().count(t), 9), len(words) + 3]
    lists = index.table("postings").selectExpr("term", "block", "most", "n", "explode(arrays_zip(at, tf, dl)) p").selectExpr("term", f"block * {1 << inverted.BITS} + p.at no", "p.tf tf", "p.dl dl", "n")
    got = {(r.term, r.chunk_id): [round(r.tf, 9), r.dl] for r in lists.join(index.table("numbers"), "no").collect()}
    assert got == want and index.n_chunks == 3000
    assert index.table("postings").groupBy("term", "block").count().where("count > 1").count() == 0
    assert {r.term: r.df for r in index.table("lexicon").collect()} == {t: sum(t == x for x, _ in want) for t, _ in want}


def test_queries_of_one_text_are_searched_once(spark, tmp_path, monkeypatch):
    """With more vectors that ask than texts, the lexical leg searches texts, and every query gets its rows."""
    from folioforge.plans import retrieval_queries

    spark.createDataFrame([(0, "alpha"), (1, "beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(301)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(i, "alpha beta\nalpha" if i % 2 else "beta", "en", "s") for i in range(70)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked, search = [], inverted.search
    monkeypatch.setattr(inverted, "search", lambda index, queries, k: asked.append(queries.count()) or search(index, queries, k))
    legs = retrieval_queries.legs_of(spark, str(tmp_path)).where("leg = 'lexical'").groupBy("query_id").count().collect()
    assert asked == [2] and {r.query_id: r["count"] for r in legs} == {q: 50 if q % 2 else 35 for q in range(7)}


def test_all_that_a_score_needs_of_a_chunk_is_in_one_row(spark, tmp_path):
    """A task scores its blocks alone, for all queries, whatever the limits of what it holds at a time."""
    import pyarrow as pa

    chunks = _chunks(spark, 300).coalesce(1)
    index = inverted.build(chunks, f"file://{tmp_path}/i")
    blocks = index.table("blocks").toArrow()
    assert blocks.num_rows == 1 and len(blocks["ids"][0]) == 302
    texts = ["w0 w1", "w2", "w3 w0 w5", "w1 head"]
    idf = {r.term: r.idf for r in index.table("lexicon").select("term", index.idf(F.col("df")).alias("idf")).collect()}
    asked = inverted.Asked([(i, t, idf[t]) for i, text in enumerate(texts) for t in text.split()])
    row = {f: blocks[f][0] for f in blocks.schema.names}
    want = {(r.query_id, r.chunk_id): r.score for r in Bm25().search(chunks, spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), None).collect()}
    for terms in (1, 1 << 15):
        inverted.TERMS, before = terms, inverted.TERMS
        parts = list(inverted.scored(row, asked, index.bm25, index.mean_length))
        inverted.TERMS = before
        got = {(int(q), i): s for qs, at, score in parts for q, i, s in zip(qs, row["ids"].values.take(pa.array(at)).to_pylist(), score, strict=True)}
        assert got == pytest.approx(want, abs=2e-9) and len(want) > 100
    assert len(parts) == 1


def test_chunks_without_an_id_are_ranked_first_of_their_score(spark, tmp_path):
    rows = [(i, "w0 w1", "") for i in ("b", None, "a", None)]
    index = inverted.build(spark.createDataFrame(rows, "chunk_id string, text string, heading_text string"), f"file://{tmp_path}/i")
    found = inverted.search(index, spark.createDataFrame([(1, "w1")], "query_id int, text string"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [None, None, "a"]


@pytest.fixture
def one_at_a_time(monkeypatch):
    """The least that a pass hands to Python is one block; a task that gets more fails."""
    from pyspark.sql.classic.dataframe import DataFrame

    real = DataFrame.mapInArrow

    def spied(self, run, *args, **kw):
        def checked(batches):
            def each():
                for batch in batches:
                    if "counts" in batch.schema.names and batch.num_rows > 1:
                        raise ValueError(f"{batch.num_rows} blocks at once")
                    yield batch

            return run(each())

        return real(self, checked, *args, **kw)

    monkeypatch.setattr(DataFrame, "mapInArrow", spied)
    monkeypatch.setattr(inverted, "HANDED", 1, raising=False)
    monkeypatch.setattr(inverted, "BITS", 4)


def test_a_search_gets_blocks_by_their_bytes(spark, tmp_path, one_at_a_time):
    chunks = _chunks(spark, 300)
    index = inverted.build(chunks, f"file://{tmp_path}/i")
    assert index.table("blocks").count() > 10
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for k in (3, None):
        assert _rows(inverted.search(index, queries, k)) == _rows(Bm25().search(chunks, queries, k))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def _documents(spark, path, n: int = 70):
    docs = [(i, "\n".join(f"alpha w{i % 7} w{j}" for j in range(i % 40)), "en", "s") for i in range(n)]
    sized = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) n_chars")
    sized.repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "alpha w1"), (1, "w3 alpha")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(101)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


@pytest.mark.parametrize("sums", [3, 1 << 18])
def test_sums_of_lists_are_of_all_blocks(spark, tmp_path, one_at_a_time, monkeypatch, sums):
    from folioforge.plans import retrieval_queries

    _documents(spark, tmp_path)
    monkeypatch.setattr(inverted, "SUMS", sums, raising=False)
    found = {r.term: (r.n_chunks, r.frequency, r.highest) for r in retrieval_queries.ret03_posting_lists(spark, str(tmp_path)).collect()}
    lines = [f"alpha w{i % 7} w{j}".split() for i in range(70) for j in range(i % 40)]
    for term in ("alpha", "w3", "w39", "w38"):
        assert found.get(term, (0, 0, 0)) == (sum(term in x for x in lines), sum(x.count(term) for x in lines), max((x.count(term) for x in lines), default=0))
    n = len(lines) + sum(i % 40 == 0 for i in range(70))
    assert found["en"] == (n, pytest.approx(0.4 * n), 0.4)


#: Queries of a table that all go by the index; each reads its blocks a few at a time.
BY_INDEX = "flagship ret03_posting_lists ret03_stemmed_search ret04_bm25 ret04_single_terms ret12_union_scored ret14_rerank ret13_hybrid_rrf ret23_merge_rankings ret14_rerank_scorer ret24_promotion ret25_assembly ret35_fusion_trace ret35_observed_stages".split()


@pytest.mark.parametrize("name", BY_INDEX)
def test_a_query_gets_blocks_by_their_bytes(spark, tmp_path, one_at_a_time, name):
    import __spark_entry__

    _documents(spark, tmp_path)
    assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() > 0


def test_blocks_lie_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A reader unpacks a page as a whole: one block's, not a task's."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(inverted, "BITS", 10)
    # The limit counts finished pages as they are packed.
    monkeypatch.setitem(getattr(inverted, "GROUPED", {}), "parquet.block.size", str(1 << 20))
    rng = random.Random(5)
    rows = [(f"c{i:05}", " ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(60)), "h") for i in range(20 << 10)]
    index = inverted.build(spark.createDataFrame(rows, "chunk_id string, text string, heading_text string").coalesce(1), f"file://{tmp_path}/i")
    groups = [g for f in (tmp_path / "i/blocks").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) == 20 and len(groups) > 1 and max(g.total_byte_size for g in groups) < 8 << 20
