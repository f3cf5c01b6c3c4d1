"""A coarse index over vectors with product-quantised codes.

``build`` fits ⌊√rows⌋ centres (or as many as are asked for, and a sixteenth of the sample at most) and, on
what vectors differ from their centres by, one codebook per sub-vector; both on a sample of at most
``SAMPLE`` vectors. It writes one row per vector: id, partition (its nearest centre), one byte per
sub-vector, and the vector, sorted by partition; a partition that holds a third of all rows is written by
several tasks. ``search`` compares whole vectors of the partitions nearest to a query. ``search_coded``
scans the codes twice: a query's products with all codewords are looked up and summed, and counted in
``BINS`` classes; from the counts comes a bound that the best ``rerank * k`` rows of each query reach, and
in the second scan a task scores by vectors the rows that reach it, and sends on ``k`` of them. However
deep a search is re-ranked, what is shuffled are counts and the ``k`` best of each task.
``calibrated`` and ``calibrated_codes`` measure recall against the exact search over stated queries and
return the least effort that reaches it; the latter from one scan, as the counts tell how deep each of the
exact search's rows lies. Vectors are of length 1 inside the index; a null or zero vector
is in none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.retrieval import SCORES, RunningTop, ann_sub_vectors, dense_batched, in_passes, matrix_of, named, top_k, unit_rows
from folioforge.plans.scratch import new_dir, written

SAMPLE = 100_000
ROUNDS = 12
SEED = 5
#: Codewords of a sub-vector: what one byte tells apart.
WORDS = 256
#: Vectors that are compared with all centres at once.
STEP = 4096
#: Classes of scores by code, each a 256th wide, from -2 upwards; those beyond count in the outermost.
BINS = 1024
#: Rows of a file of the index, where that makes more files than there are cores.
FILE_ROWS = 100_000


@dataclass(frozen=True)
class Index:
    path: str
    centres: np.ndarray
    #: Codewords by sub-vector: sub-vectors x WORDS x their components.
    books: np.ndarray
    rows: int

    def table(self, spark: SparkSession) -> DataFrame:
        """``chunk_id, vector, part, codes``."""
        return spark.read.parquet(f"{self.path}/codes")


def opened(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` has written."""
    fitted = spark.read.parquet(f"{path}/fitted")
    rows = {r["kind"]: r for r in fitted.collect()}
    return Index(path, *(np.array(rows[kind]["values"]).reshape(rows[kind]["shape"]) for kind in ("centres", "books")), rows["centres"]["rows"])


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centre by Euclidean distance, and the squared distance; some rows at a time."""
    own, far = np.empty(len(rows), np.int64), np.empty(len(rows))
    half = (centres**2).sum(1) / 2
    for i in range(0, len(rows), STEP):
        part = rows[i : i + STEP]
        score = part @ centres.T - half
        own[i : i + STEP] = best = score.argmax(1)
        far[i : i + STEP] = (part**2).sum(1) - 2 * score[np.arange(len(part)), best]
    return own, far


def centres_of(sample: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = SEED, spherical: bool = True) -> np.ndarray:
    """k-means, of centres of length 1 if ``spherical``; a centre that loses all its members takes the worst served vector."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        own, far = nearest(sample, centres)
        count = np.bincount(own, minlength=n)
        sums = np.stack([np.bincount(own, column, n) for column in sample.T], axis=1)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            sums[empty], count[empty] = sample[np.argsort(-far)[: len(empty)]], 1
        centres = _unit(sums) if spherical else sums / count[:, None]
    return centres


def codebooks(rest: np.ndarray, sub_vectors: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Codewords of each sub-vector of what vectors differ from their centres by; the last is repeated where there are too few."""
    books = []
    for part in np.split(rest, sub_vectors, axis=1):
        book = centres_of(part, min(WORDS, len(part)), rounds, seed, spherical=False)
        books.append(np.concatenate([book, np.repeat(book[-1:], WORDS - len(book), axis=0)]))
    return np.stack(books)


def encoded(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest codeword of each sub-vector: rows x sub-vectors, a byte each."""
    return np.stack([nearest(part, book)[0] for part, book in zip(np.split(rest, len(books), axis=1), books, strict=True)], axis=1).astype(np.uint8)


def build(vectors: DataFrame, partitions: int | None = None, sample: int = SAMPLE, sub_vectors: int | None = None, path: str | None = None) -> Index:
    """Index ``chunk_id, vector`` below ``path``, or else in the shared folder. The sample is the least by a hash of the ids, so it is the same each time.

    Without ``sub_vectors`` there are as many as leave sixteen components at least to each.
    """
    known = vectors.where("vector is not null").select("chunk_id", "vector")
    n = known.count()
    if n == 0:
        raise ValueError("no vectors to index")
    draw = F.xxhash64(F.col("chunk_id").cast("string"))
    some = known.orderBy(draw, "chunk_id").limit(sample).select("vector")
    data = _unit(np.array([r[0] for r in some.collect()], np.float64))
    data = data[np.abs(data).sum(1) > 0]
    if not len(data):
        raise ValueError("no vectors to index")
    centres = centres_of(data, min(len(data), partitions or max(1, min(len(data) // 16, int(n**0.5)))))
    books = codebooks(data - centres[nearest(data, centres)[0]], sub_vectors or ann_sub_vectors(data.shape[1]))
    spark = vectors.sparkSession
    # A sixteenth of the sample at most, and 256 codewords per sub-vector: bounded whatever the table's size.
    shared = spark.sparkContext.broadcast((centres, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        for batch in batches:
            rows = np.asarray(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, centres.shape[1]))
            live = np.flatnonzero(np.abs(rows).sum(1) > 0)
            rows = _unit(rows[live])
            part = nearest(rows, centres)[0]
            codes = encoded(rows - centres[part], books) if len(live) else np.zeros((0, len(books)), np.uint8)
            kept = batch.take(pa.array(live))
            yield pa.record_batch([kept.column("chunk_id"), kept.column("vector"), pa.array(part.astype(np.int32)), pa.array(map(bytes, codes), pa.binary())], ["chunk_id", "vector", "part", "codes"])

    path = path or new_dir(spark, "ann")
    kind = vectors.schema["chunk_id"].dataType.simpleString()
    placed = written(known.mapInArrow(run, f"chunk_id {kind}, vector {vectors.schema['vector'].dataType.simpleString()}, part int, codes binary"), "ann-placed")
    files = max(spark.sparkContext.defaultParallelism, n // FILE_ROWS)
    placed.repartitionByRange(files, "part", F.xxhash64("chunk_id")).sortWithinPartitions("part").write.parquet(f"{path}/codes")
    fitted = [(kind, list(x.shape), x.reshape(-1).tolist(), n) for kind, x in (("centres", centres), ("books", books))]
    spark.createDataFrame(fitted, "kind string, shape array<int>, values array<double>, rows long").coalesce(1).write.parquet(f"{path}/fitted")
    return Index(path, centres, books, n)


def _probed(spark: SparkSession, index: Index, matrix: np.ndarray, probes: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Rows of the partitions that any query probes, and the queries of each partition."""
    near = np.argsort(-(matrix @ index.centres.T), axis=1, kind="stable")[:, :probes]
    asked = np.repeat(np.arange(len(near)), near.shape[1])
    order = np.argsort(near.reshape(-1), kind="stable")
    parts, first = np.unique(near.reshape(-1)[order], return_index=True)
    by_part = {int(p): np.sort(qs) for p, qs in zip(parts, np.split(asked[order], first[1:]), strict=True)}
    return index.table(spark).where(F.col("part").isin(*by_part)) if by_part else index.table(spark).limit(0), by_part


def _met(batches: Iterator[pa.RecordBatch], asked_of: dict[int, np.ndarray]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Rows of one partition, the partition, and some of the queries that probe it."""
    for batch in batches:
        parts = np.asarray(batch.column("part"))
        for p in np.unique(parts).tolist():
            qs = asked_of.get(p, np.zeros(0, np.int64))
            mine = batch.take(pa.array(np.flatnonzero(parts == p)))
            step = max(1, SCORES // max(1, mine.num_rows))
            for some in np.split(qs, range(step, len(qs), step)):
                if len(some):
                    yield mine, p, some


def _best(best: RunningTop) -> Iterator[pa.RecordBatch]:
    if (found := best.rows()) is not None:
        yield pa.record_batch([pa.array(found[0]), found[1], pa.array(found[2])], ["q", "chunk_id", "score"])


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int, most_queries: int = 10_000) -> DataFrame:
    """``query_id, chunk_id, score, rank`` from the ``probes`` partitions nearest to each query, by whole vectors.

    Each vector meets only the queries that probe its partition; about ``most_queries`` go in one pass.
    """

    def one_pass(some: DataFrame) -> DataFrame:
        names, matrix = matrix_of(some, index.centres.shape[1])
        rows, by_part = _probed(spark, index, matrix, probes)
        shared, kind = spark.sparkContext.broadcast((by_part, matrix)), rows.schema["chunk_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_of, asked = shared.value
            best = RunningTop(k, queries=len(asked))
            for mine, _, qs in _met(batches, asked_of):
                best.add_best(qs, asked, unit_rows(mine.column("vector"), mine.num_rows), mine.column("chunk_id"))
            yield from _best(best)

        found = rows.select("chunk_id", "vector", "part").mapInArrow(run, f"q long, chunk_id {kind}, score double")
        return top_k(named(found, names, some).select("query_id", "chunk_id", "score"), k)

    return in_passes(queries, most_queries, one_pass)


@dataclass(frozen=True)
class _Asked:
    """A pass of queries over the codes: their ids, the rows they probe, and what tasks are sent."""

    names: list
    rows: DataFrame
    #: Queries of each partition, the queries, their products with each centre and, per sub-vector, with each codeword.
    shared: Broadcast

    @staticmethod
    def of(spark: SparkSession, index: Index, queries: DataFrame, probes: int, visible: DataFrame | None = None) -> _Asked:
        names, matrix = matrix_of(queries, index.centres.shape[1])
        rows, by_part = _probed(spark, index, matrix, probes)
        if visible is not None:
            rows = rows.join(visible.select("chunk_id"), "chunk_id", "left_semi")
        tables = np.einsum("qms,mws->qmw", matrix.reshape(len(matrix), len(index.books), -1), index.books)
        return _Asked(names, rows, spark.sparkContext.broadcast((by_part, matrix, matrix @ index.centres.T, tables)))

    def depths(self, depth: int | None = None) -> DataFrame:
        """``q, bin, above``: how many rows of a query's probed partitions are in higher classes, of each class with
        rows; with a ``depth``, of those classes only that have fewer above them."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = shared.value
            counts = np.zeros((len(state[1]), BINS), np.int32)
            for mine, p, qs in _met(batches, state[0]):
                np.add.at(counts.reshape(-1), qs[:, None] * BINS + _bins(_code_scores(state, _codes(mine), p, qs)), 1)
            for start in range(0, len(counts), STEP):
                some = counts[start : start + STEP]
                wanted = some > 0
                if depth is not None:
                    wanted &= np.cumsum(some[:, ::-1], axis=1)[:, ::-1] - some < depth
                q, b = np.nonzero(wanted)
                yield pa.record_batch([pa.array(q + start), pa.array(b.astype(np.int32)), pa.array(some[q, b].astype(np.int64))], ["q", "bin", "n"])

        sums = self.rows.select("part", "codes").mapInArrow(run, "q long, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        higher = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        found = sums.select("q", "bin", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"))
        return found if depth is None else found.where(F.col("above") < depth)


def _codes(rows: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def _code_scores(state: tuple, codes: np.ndarray, part: int, qs: np.ndarray) -> np.ndarray:
    """Scores by code of a partition's rows: queries x rows."""
    out = np.repeat(state[2][qs, part][:, None], len(codes), axis=1)
    for m in range(codes.shape[1]):
        out += state[3][qs, m][:, codes[:, m]]
    return out


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.clip((scores + 2) * 256, 0, BINS - 1).astype(np.int64)


def search_coded(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int, rerank: int = 10, visible: DataFrame | None = None, most_queries: int = 10_000) -> DataFrame:
    """The same result from codes: of each query the best ``rerank * k`` by code, and those in one class with the last, are scored by their vectors.

    ``visible`` (``chunk_id``) restricts the rows before anything is ranked.
    """

    def one_pass(some: DataFrame) -> DataFrame:
        asked = _Asked.of(spark, index, some, probes, visible)
        lowest = np.full(len(asked.names), BINS, np.int64)
        for r in asked.depths(k * rerank).groupBy("q").agg(F.min("bin").alias("bin")).collect():
            lowest[r["q"]] = r["bin"]
        shared, bounds, kind = asked.shared, spark.sparkContext.broadcast(lowest), asked.rows.schema["chunk_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, lowest = shared.value, bounds.value
            best = RunningTop(k, queries=len(lowest))
            for mine, p, qs in _met(batches, state[0]):
                i, j = np.nonzero(_bins(_code_scores(state, _codes(mine), p, qs)) >= lowest[qs][:, None])
                best.add_pairs(qs[i], j, state[1], unit_rows(mine.column("vector"), mine.num_rows), mine.column("chunk_id"))
            yield from _best(best)

        found = asked.rows.select("chunk_id", "part", "codes", "vector").mapInArrow(run, f"q long, chunk_id {kind}, score double")
        return top_k(named(found, asked.names, some).select("query_id", "chunk_id", "score"), k)

    return in_passes(queries, most_queries, one_pass)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact search's rows that were found."""
    n = exact.count()
    return found.join(exact, ["query_id", "chunk_id"], "left_semi").count() / n if n else 1.0


def calibrated(spark: SparkSession, index: Index, vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.9) -> tuple[int, float]:
    """The fewest probes, by doubling, that reach the recall on the stated queries; all partitions reach any."""
    exact = written(dense_batched(vectors, queries, k).select("query_id", "chunk_id"), "exact")
    probes = 1
    while True:
        got = recall(search(spark, index, queries, k, probes).select("query_id", "chunk_id"), exact)
        if got >= least or probes >= len(index.centres):
            return probes, got
        probes = min(len(index.centres), 2 * probes)


def calibrated_codes(spark: SparkSession, index: Index, vectors: DataFrame, queries: DataFrame, k: int, probes: int, least: float = 0.9, exact: DataFrame | None = None, most_queries: int = 10_000) -> tuple[int, float]:
    """The least ``rerank``, by doubling, with which the search over codes reaches the recall; as many as there are rows reach any.

    A row of the exact search is found if fewer than ``rerank * k`` rows are in higher classes, so one scan settles all
    depths. ``exact`` (``query_id, chunk_id``) is that search's result, if it is at hand.
    """
    if exact is None:
        exact = written(dense_batched(vectors, queries, k).select("query_id", "chunk_id"), "exact")
    n = exact.count()

    def one_pass(some: DataFrame) -> DataFrame:
        asked = _Asked.of(spark, index, some, probes)
        shared = asked.shared
        q_of = spark.createDataFrame([(i, x) for i, x in enumerate(asked.names)], f"q long, query_id {some.schema['query_id'].dataType.simpleString()}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = shared.value
            for batch in batches:
                parts, q = np.asarray(batch.column("part")), np.asarray(batch.column("q"))
                codes = _codes(batch)
                score = state[2][q, parts]
                for m in range(codes.shape[1]):
                    score += state[3][q, m, codes[:, m]]
                met = np.zeros(len(q), bool)
                for p in np.unique(parts).tolist():
                    own = np.flatnonzero(parts == p)
                    met[own] = np.isin(q[own], state[0].get(p, q[:0]))
                yield pa.record_batch([pa.array(q[met]), pa.array(_bins(score[met]).astype(np.int32))], ["q", "bin"])

        placed = exact.join(q_of, "query_id").join(index.table(spark).select("chunk_id", "part", "codes"), "chunk_id").select("q", "part", "codes")
        return placed.mapInArrow(run, "q long, bin int").join(asked.depths(), ["q", "bin"]).select("above")

    # ``in_passes`` takes shares of the queries; a pass finds its own queries' rows among ``exact``.
    depths = [4]
    while depths[-1] * k < index.rows:
        depths.append(2 * depths[-1])
    above = in_passes(queries, most_queries, one_pass)
    found = above.agg(*[F.count_if(F.col("above") < d * k).alias(str(d)) for d in depths]).first()
    reached = [(d, found[str(d)] / n if n else 1.0) for d in depths]
    return next(((d, got) for d, got in reached if got >= least), reached[-1])
