"""A kept inverted index: posting lists by blocks of chunks, a lexicon, and a search that reads no text.

``build`` numbers the chunks, tokenises them once and makes the posting lists of a block of consecutive numbers
in the task that has them: neither occurrences nor lists are shuffled. It writes three Parquet tables:

* ``blocks``: a row per block of ``1 << BITS`` consecutive numbers at most: the ids and lengths of its chunks, its terms with
  how many postings each has, and the postings of all of them as two arrays of fixed width, the places in the block and the
  weighted frequencies;
* ``lexicon``: in how many chunks and blocks each term is;
* ``corpus``: one row: chunks, and their mean length.

``postings`` (a row per term and block) and ``numbers`` (``no, chunk_id``) are read out of the blocks.

``search`` gives what ``Bm25.search`` gives over the same chunks. Every term of a query must match, and all that a score
needs of a chunk stands in one row, so a task scores its blocks for all queries and keeps the ``k`` best of each; those alone are
shuffled. In a block a query's chunks are the common bits of its terms' bitmaps, and only those are scored.

A block's row is bounded by its chunks; nothing grows with a term that is everywhere. Rows go to Python ``HANDED`` bytes at a time,
whatever the session hands on at once, and what a pass makes of them is written. The one row of ``corpus`` comes to the
driver, and the terms of ``MOST_QUERIES`` queries at a time, which are broadcast; further ones are further passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.retrieval import Bm25, RunningTop, in_passes, named, top_k
from folioforge.plans.scratch import new_dir

BITS = 10
#: Blocks after which a task drops what can't be among the best of a query any more.
BEST = 8
#: Queries in one pass over the blocks.
MOST_QUERIES = 25_000
#: Terms of queries whose bitmaps a task holds at a time.
TERMS = 1 << 15
#: Bytes of blocks that a task hands to Python at a time, a block at least. A session's own limit is 64 MB, which takes the JVM
#: several times as much outside of its heap: the vectors of a batch, twice while they grow, and its serialised form.
HANDED = 1 << 22
#: Row groups of a few blocks, and pages of one: Parquet looks at sizes only after a hundred rows, and by then a page, which is
#: unpacked outside of the heap as a whole, would have most of a task's blocks.
GROUPED = {"parquet.block.size": str(1 << 22), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Sums of terms that a task holds.
SUMS = 1 << 18
PLACE, WEIGHT, LENGTH = np.uint16, np.float64, np.int32


@dataclass(frozen=True)
class InvertedIndex:
    spark: SparkSession
    path: str
    bm25: Bm25
    n_chunks: int
    mean_length: float

    def table(self, name: str) -> DataFrame:
        if name == "numbers":
            at = self.table("blocks").select("block", F.posexplode("ids").alias("at", "chunk_id"))
            # An id that is null has a number like any other.
            return at.select(F.shiftleft("block", BITS).bitwiseOR(F.col("at").cast("long")).alias("no"), "chunk_id")
        if name == "postings":
            lists = self.table("blocks").select("block", "terms", "counts", "at", "tf", "dl").mapInArrow(_unpacked, "term string, block long, n int, at array<short>, tf array<double>, dl array<int>")
            return lists.withColumn("most", F.array_max(F.zip_with("tf", "dl", lambda tf, dl: _saturated(self.bm25, tf, dl, self.mean_length))))
        return self.spark.read.parquet(f"{self.path}/{name}")

    def passed(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: list[str], schema: str, label: str) -> DataFrame:
        """What ``run`` makes of the blocks' columns, written. The limit of a batch is a session's setting, so the pass has a session
        of its own and that of the caller stays as it is."""
        own, path = self.spark.newSession(), new_dir(self.spark, label)
        own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(HANDED))
        own.read.parquet(f"{self.path}/blocks").select(*columns).mapInArrow(run, schema).write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def idf(self, df: Column) -> Column:
        return F.greatest(F.log((self.n_chunks - df + 0.5) / (df + 0.5)), F.lit(self.bm25.idf_floor))


def _saturated(bm25: Bm25, tf, dl, mean_length: float):
    """A posting's part of a score, but for the term's weight; of columns or of arrays."""
    return tf * (bm25.k1 + 1) / (tf + bm25.k1 * (1 - bm25.b + bm25.b * dl / mean_length))


def build(chunks: DataFrame, path: str, bm25: Bm25 = Bm25()) -> InvertedIndex:  # noqa: B008
    """Index ``chunk_id`` and the fields of ``bm25`` below ``path``, which must be new."""
    spark, weights = chunks.sparkSession, [w for _, w in bm25.weights]
    fields, bits = [f"t{i}" for i in range(len(weights))], BITS
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    split = chunks.select("chunk_id", F.monotonically_increasing_id().alias("no"), *[bm25.spaced(F.coalesce(F.col(f), F.lit(""))).alias(t) for t, (f, _) in zip(fields, bm25.weights, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            blocks = np.asarray(batch.column("no")) >> bits
            starts = np.flatnonzero(np.diff(blocks, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if blocks[start] != block:
                    if held:
                        yield _lists(block, held, fields, weights, bits)
                    block, held = int(blocks[start]), []
                held.append(batch.slice(start, end - start))
        if held:
            yield _lists(block, held, fields, weights, bits)

    split.mapInArrow(run, f"block long, ids array<{kind}>, total long, terms array<string>, counts array<int>, at binary, tf binary, dl binary").write.options(**GROUPED).parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = blocks.select(F.size("ids").alias("n"), "total")
    lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("total") / F.sum("n"), F.lit(0.0)).alias("mean_length")).write.parquet(f"{path}/corpus")
    counts = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    counts.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("n_blocks")).write.parquet(f"{path}/lexicon")
    return opened(spark, path, bm25)


def _lists(block: int, held: list[pa.RecordBatch], fields: list[str], weights: list[float], bits: int) -> pa.RecordBatch:
    """A block as one row: ids and lengths of its chunks, and the places and frequencies of its terms, one term after another."""
    first, places, terms, weighs, lengths = 0, [], [], [], []
    for batch in held:
        length = np.zeros(batch.num_rows, np.int64)
        for f, w in zip(fields, weights, strict=True):
            split = pc.split_pattern(batch.column(f), " ")
            words, of = split.flatten(), np.asarray(pc.list_parent_indices(split))
            # Blanks at either end, and an empty field, give empty words.
            real = np.asarray(pc.binary_length(words)) > 0
            if not real.all():
                words, of = words.filter(pa.array(real)), of[real]
            length += np.bincount(of, minlength=batch.num_rows)
            places.append(first + of)
            terms.append(words)
            weighs.append(np.full(len(words), w))
        lengths.append(length)
        first += batch.num_rows
    coded = pa.concat_arrays(terms).dictionary_encode()
    n_terms = len(coded.dictionary)
    key = (np.asarray(coded.indices).astype(np.int64) << bits) | np.concatenate(places).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.concatenate(weighs)[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.add.reduceat(weight, starts) if len(key) else weight
    key, dl = key[starts], np.concatenate(lengths)
    one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
    columns = {
        "block": pa.array([block]),
        "ids": one(pa.concat_arrays([b.column("chunk_id") for b in held])),
        "total": pa.array([int(dl.sum())]),
        "terms": one(coded.dictionary),
        "counts": one(pa.array(np.bincount(key >> bits, minlength=n_terms).astype(np.int32))),
        "at": pa.array([(key & ((1 << bits) - 1)).astype(PLACE).tobytes()], pa.binary()),
        "tf": pa.array([tf.astype(WEIGHT).tobytes()], pa.binary()),
        "dl": pa.array([dl.astype(LENGTH).tobytes()], pa.binary()),
    }
    return pa.record_batch(list(columns.values()), list(columns))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting lists of each block as rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f: batch.column(f)[i] for f in batch.schema.names}
            n, (at, tf, dl) = np.asarray(row["counts"].values), _arrays(row)
            ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int16), tf, dl[at])]
            yield pa.record_batch([row["terms"].values, pa.array(np.full(len(n), row["block"].as_py())), pa.array(n), *lists], ["term", "block", "n", "at", "tf", "dl"])


def summed(index: InvertedIndex) -> DataFrame:
    """``term, n, f, m``: postings of a term, the sum of their frequencies and the highest, in one row or a few of each task."""
    return index.passed(_summed, ["terms", "counts", "tf"], "term string, n long, f double, m double", "sums")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, held, size = ["term", "n", "f", "m"], [], 0

    def met() -> pa.Table:
        sums = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("n", "sum"), ("f", "sum"), ("m", "max")])
        return sums.select(["term", "n_sum", "f_sum", "m_max"]).rename_columns(names)

    for batch in batches:
        for i in range(batch.num_rows):
            n = np.asarray(batch.column("counts")[i].values).astype(np.int64)
            if not len(n):
                continue
            tf, begin = np.frombuffer(batch.column("tf")[i].as_buffer(), WEIGHT), np.cumsum(n) - n
            # A copy, as a slice would keep all of its batch.
            terms = pa.concat_arrays([batch.column("terms")[i].values, pa.array([], pa.string())])
            held.append(pa.table([terms, n, np.add.reduceat(tf, begin), np.maximum.reduceat(tf, begin)], names))
            size += len(n)
            if size > SUMS:
                held = [met()]
                size = len(held[0])
                if size > SUMS // 2:
                    yield from held[0].to_batches(1 << 14)
                    held, size = [], 0
    if held:
        yield from met().to_batches(1 << 14)


def _arrays(row: dict[str, pa.Scalar]) -> list[np.ndarray]:
    return [np.frombuffer(row[f].as_buffer(), kind) for f, kind in (("at", PLACE), ("tf", WEIGHT), ("dl", LENGTH))]


def opened(spark: SparkSession, path: str, bm25: Bm25 = Bm25()) -> InvertedIndex:  # noqa: B008
    row = spark.read.parquet(f"{path}/corpus").first()
    return InvertedIndex(spark, path, bm25, row["n_chunks"], row["mean_length"])


class Asked:
    """Queries as places in a list of distinct terms: ``terms[starts[q]:starts[q + 1]]`` are those of query ``q``."""

    def __init__(self, rows: list[tuple[int, str, float]]):
        query = np.array([r[0] for r in rows], np.int64)
        coded = pa.array([r[1] for r in rows], pa.string()).dictionary_encode()
        self.vocabulary = coded.dictionary
        order = np.argsort(query, kind="stable")
        self.terms = np.asarray(coded.indices).astype(np.int64)[order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(query)))).astype(np.int64)
        self.idf = np.zeros(len(self.vocabulary))
        self.idf[np.asarray(coded.indices)] = [r[2] for r in rows]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of a start and a size, one after another."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def scored(row: dict[str, pa.Scalar], asked: Asked, bm25: Bm25, mean_length: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, places and scores of a block's chunks that hold every term of a query."""
    n, (at, tf, dl) = np.asarray(row["counts"].values).astype(np.int64), _arrays(row)
    place = np.asarray(pc.fill_null(pc.index_in(asked.vocabulary, value_set=row["terms"].values), -1)).astype(np.int64)
    sizes = np.diff(asked.starts)
    there = np.flatnonzero(np.logical_and.reduceat(place[asked.terms] >= 0, asked.starts[:-1]))
    if not len(there):
        return
    begin = np.cumsum(n) - n
    # Bitmaps of the terms of those queries alone.
    used = np.unique(asked.terms[ranges(asked.starts[there], sizes[there])])
    line = np.zeros(len(place), np.int64)
    line[used] = np.arange(len(used))
    bits = np.zeros((len(used), -(-len(dl) // 64) * 64), bool)
    held = n[place[used]]
    bits[np.repeat(np.arange(len(used)), held), at[ranges(begin[place[used]], held)]] = True
    bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    # Postings ascend by term and place, so a posting is found by both.
    key = np.repeat(np.arange(len(n)), n) * len(dl) + at
    share = np.cumsum(sizes[there]) // TERMS
    for qs in np.split(there, np.flatnonzero(np.diff(share)) + 1):
        size = sizes[qs]
        terms = asked.terms[ranges(asked.starts[qs], size)]
        common = np.bitwise_and.reduceat(bits[line[terms]], np.cumsum(size) - size, axis=0)
        some = np.flatnonzero(common.any(axis=1))
        if not len(some):
            continue
        q, where = np.nonzero(np.unpackbits(common[some].view(np.uint8), axis=1, bitorder="little"))
        q = some[q]
        # Some hits at a time: each has all terms of its query.
        for hits in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(size[q]) // (TERMS * 8))) + 1):
            sized = size[q[hits]]
            of = terms[ranges((np.cumsum(size) - size)[q[hits]], sized)]
            posting = np.searchsorted(key, place[of] * len(dl) + np.repeat(where[hits], sized))
            part = asked.idf[of] * _saturated(bm25, tf[posting], dl[at[posting]], mean_length)
            yield qs[q[hits]], where[hits], np.round(np.add.reduceat(part, np.cumsum(sized) - sized), bm25.digits)


def search(index: InvertedIndex, queries: DataFrame, k: int | None, visible: DataFrame | None = None) -> DataFrame:
    """The ``k`` best chunks of each query that hold all of its terms: ``query_id, chunk_id, score, rank``;
    without ``k`` all that do, not ranked.

    ``queries`` has ``query_id, text``; ``visible`` (``chunk_id``) restricts the result before it is ranked.
    """
    return in_passes(queries, MOST_QUERIES, lambda some: _pass(index, some, k, visible))


def _pass(index: InvertedIndex, queries: DataFrame, k: int | None, visible: DataFrame | None) -> DataFrame:
    terms = queries.select("query_id", F.array_distinct(index.bm25.terms(F.col("text"))).alias("ts")).where(F.size("ts") > 0)
    terms = terms.select("query_id", F.size("ts").alias("n_terms"), F.explode("ts").alias("term"))
    known = terms.join(index.table("lexicon").select("term", "df"), "term")
    # A query with a term that is nowhere has no hits.
    whole = known.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where("known = n_terms")
    rows = whole.select("query_id", "term", index.idf(F.col("df")).alias("idf")).collect()
    names = list(dict.fromkeys(r[0] for r in rows))
    number = {name: i for i, name in enumerate(names)}
    shared = index.spark.sparkContext.broadcast(Asked(sorted((number[r[0]], r[1], r[2]) for r in rows)))
    bm25, mean_length = index.bm25, index.mean_length
    # What isn't visible can't be told here, so then all that match go on.
    most = k if visible is None else None
    kind = index.table("blocks").schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best, seen = None if most is None else RunningTop(most, queries=len(asked.starts) - 1), 0
        batch_of = lambda q, ids, score: pa.record_batch([pa.array(q), ids, pa.array(score)], ["q", "chunk_id", "score"])
        for batch in batches if len(asked.terms) else ():
            for i in range(batch.num_rows):
                row = {f: batch.column(f)[i] for f in batch.schema.names}
                for q, at, score in scored(row, asked, bm25, mean_length):
                    if best is None:
                        yield batch_of(q, row["ids"].values.take(pa.array(at)), score)
                        continue
                    wanted = score >= best.least[q]
                    best.add(q[wanted], row["ids"].values.take(pa.array(at[wanted])), score[wanted])
                seen += 1
                if best is not None and seen % BEST == 0:
                    best.rows()
        if best is not None and (rows := best.rows()) is not None:
            yield batch_of(*rows)

    hits = index.passed(run, ["ids", "terms", "counts", "at", "tf", "dl"], f"q long, chunk_id {kind}, score double", "hits")
    found = named(hits, names, queries)
    found = found.select("query_id", "chunk_id", F.round("score", bm25.digits).alias("score"))
    if visible is not None:
        found = found.join(visible.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", "score")
    return found if k is None else top_k(found, k)


def kept(chunks: DataFrame, name: str, bm25: Bm25 = Bm25()) -> InvertedIndex:  # noqa: B008
    """The index of chunks that are derived from the files they are read from, built by the first call of a session.

    ``name`` tells apart chunks derived in different ways. An index of files that have changed since, in
    name, length or time, is another one.
    """
    spark = chunks.sparkSession
    hadoop, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    state = []
    for file in sorted(chunks.inputFiles()):
        path = path_of(file)
        status = path.getFileSystem(hadoop).getFileStatus(path)
        state.append((file, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, bm25, tuple(state))
    if key not in _KEPT:
        _KEPT[key] = build(chunks, new_dir(spark, "inverted"), bm25)
    return _KEPT[key]


_KEPT: dict[tuple, InvertedIndex] = {}
