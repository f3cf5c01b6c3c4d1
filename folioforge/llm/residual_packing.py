"""Best-fit packing of token sequences by hierarchical residual packing.

Each task packs the pieces of its own documents by best fit, largest first, and emits the
bins that are full but for ``slack`` tokens. The underfull ones become items of the next
round, which merges those of ``FAN_IN`` tasks in the same way, and so on to one merge for
all. A bin carries its pieces, 1024 at most, so no round looks anything up.

What travels is bounded without loss. Best fit leaves at most one bin at most half full, as
two such bins would be one; only such a bin can go into another one. So a merge places
``FAN_IN`` bins at most, and of underfull bins with equally many tokens free none can ever
be used beyond ``FAN_IN`` for each round still to come. A merge sends that many of each
size upwards and emits the others; any cap below it would change the result, none above does.

Only documents longer than a sequence are cut: their full pieces are the last ones, and the
first holds the rest. Cases: a null or empty text has the end id alone; a very long text is
encoded whole and its full pieces are emitted at once; of equal sizes the first in order is
packed first; repeated rows of one id, and those without an id, are documents of their own,
packed each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import key_runs, known_id, shown_id, slices, tidy
from folioforge.llm.pfor_tokens import encoder
from folioforge.plans.scratch import written

LENGTH = 1024
END_ID = 2
SLACK = 1
FAN_IN = 8
#: Rounds that the merges of 2 ** 31 tasks take, the most that Spark has.
MOST_ROUNDS = 11
#: Items that a task gathers before it packs them with the underfull bins it has.
AT_ONCE = 200_000
#: Documents of a task at least: tasks of few pieces leave many bins above half full, which no merge can join.
LEAST_ROWS = 2000
#: What a bin keeps of a piece, besides its place.
FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")
BIN = "part long, sequence_id long, fill long, closed boolean, members array<struct<doc_id:long,piece:long,start:long,length:long,ids_crc32:long,offset:long>>"


def best_fit(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers: largest items first, each where it leaves the least space."""
    bins: list[list[int]] = []
    with_free: list[list[int]] = [[] for _ in range(length + 1)]
    some = 0  # bit f is set if a bin has f tokens free
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = some >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = with_free[free].pop()
            if not with_free[free]:
                some &= ~(1 << free)
        else:
            free, b = length, len(bins)
            bins.append([])
        bins[b].append(i)
        left = free - size
        with_free[left].append(b)
        if left:
            some |= 1 << left
    return bins


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of ``n`` tokens."""
    if n <= length:
        return [(0, n)]
    first = n % length
    starts = ([0] if first else []) + list(range(first, n, length))
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], n], strict=True)], strict=True))


def _batch(part: int, ids: list[int], fills: list[int], rows: list[list[tuple]]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.array([m for r in rows for m in r], np.int64).reshape(-1, 6)
    names = [*FIELDS, "offset"]
    members = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(6)], names))
    columns = [pa.array([part] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(fills, pa.int64()), pa.array([False] * len(ids), pa.bool_()), members]
    return pa.record_batch(columns, ["part", "sequence_id", "fill", "closed", "members"])


def _merged(part: int, first_id: int, items: list[list[tuple]], held: pa.Table | None, length: int) -> pa.Table:
    """Best fit of items, each a list of placed pieces, and of held bins; a bin that nothing joins stays as it is."""
    fills = held.column("fill").to_pylist() if held is not None else []
    sizes = [sum(m[3] for m in i) for i in items] + fills
    alone, ids, made_fills, made = [], [], [], []
    for members in best_fit(sizes, length):
        if len(members) == 1 and members[0] >= len(items):
            alone.append(members[0] - len(items))
            continue
        placed, at = [], 0
        for i in members:
            pieces = items[i] if i < len(items) else [(*(m[f] for f in FIELDS), m["offset"]) for m in held.column("members")[i - len(items)].as_py()]
            placed += [(*m[:5], m[5] + at) for m in pieces]
            at += sizes[i]
        ids.append(first_id + len(ids))
        made_fills.append(at)
        made.append(placed)
    out = pa.Table.from_batches([_batch(part, ids, made_fills, made)])
    if not alone:
        return out
    kept = held.take(pa.array(alone))
    return pa.concat_tables([out, kept.set_column(0, "part", pa.array([part] * len(alone), pa.int64())).cast(out.schema)])


def _closed(bins: pa.Table, length: int, slack: int, spare: int) -> pa.Table:
    """Close the full bins and, of those with equally many tokens free, all beyond ``spare``."""
    met: Counter = Counter()
    closed = []
    for fill in bins.column("fill").to_pylist():
        met[fill] += 1
        closed.append(length - fill <= slack or met[fill] > spare)
    return bins.set_column(3, "closed", pa.array(closed, pa.bool_()))


def _first(tokenizer: str, end_id: int, length: int, slack: int, spare: int, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        items: list[list[tuple]] = []
        held: pa.Table | None = None
        number = part << 32
        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                ids, offsets = enc.encode_column(batch.column(1))
                full: list[list[tuple]] = []
                wide = ids.astype("<u4")
                tail = np.array([end_id], "<u4")
                for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.concatenate((wide[a:b], tail)).tobytes()
                    for piece, (start, size) in enumerate(cut(b - a + 1, length)):
                        row = [(doc, piece, start, size, zlib.crc32(own[4 * start : 4 * (start + size)]), 0)]
                        (full if size == length else items).append(row)
                if full:
                    done = pa.Table.from_batches([_batch(part, list(range(number, number + len(full))), [length] * len(full), full)])
                    yield from _closed(done, length, slack, 0).to_batches()
                    number += len(full)
                if len(items) >= at_once:
                    held = _merged(part, number, items, held, length)
                    number += len(items)
                    items = []
        if items or held is not None:
            yield from _closed(_merged(part, number, items, held, length).combine_chunks(), length, slack, spare).to_batches()
        tidy()

    return run


def _next(level: int, length: int, slack: int, spare: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins in key_runs(batches, "part"):
            part = bins.column("part")[0].as_py()
            merged = _merged(part, (level << 56) | (part << 32), [], bins.combine_chunks(), length)
            yield from _closed(merged.combine_chunks(), length, slack, spare).to_batches()
        tidy()

    return run


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = LENGTH, slack: int = SLACK, spare: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``spare`` replaces the number of underfull bins of a size that go upwards, which tests use.
    """
    texts = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"))
    useful = lambda rounds: FAN_IN * rounds if spare is None else spare
    tasks = max(1, texts.count() // LEAST_ROWS)
    texts = texts if texts.rdd.getNumPartitions() <= tasks else texts.coalesce(tasks)
    level = written(texts.mapInArrow(_first(tokenizer, end_id, length, slack, useful(MOST_ROUNDS), at_once), BIN), "bins")
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    rounds = 0
    while FAN_IN**rounds < parts:
        rounds += 1
    bins = level if rounds == 0 else level.where("closed")
    for n in range(1, rounds + 1):
        # The same merges whatever tasks they run in: groups by part, ordered by id.
        rest = level.where("not closed").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        dealt = rest.repartition(-(-parts // FAN_IN**n), "part").sortWithinPartitions("part", "sequence_id")
        level = written(dealt.mapInArrow(_next(n, length, slack, useful(rounds - n)), BIN), "bins")
        bins = bins.unionByName(level.where("closed") if n < rounds else level)
    rows = bins.select("sequence_id", F.explode("members").alias("m"))
    return rows.select(shown_id(F.col("m.doc_id")).alias("doc_id"), F.col("m.piece").cast("int").alias("piece"), "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
