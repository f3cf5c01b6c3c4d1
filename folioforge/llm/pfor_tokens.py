"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of a run of whole documents in ascending id order. Ids are cut into
blocks of 256: a block stores its minimum, and each id less that in the width that a chosen
percentile of them needs; the ids that need more are kept whole in the block's exception
list. An index gives every block's place, so ids are read from any point on, and another
gives each document's id and first token.

Layout, little-endian: magic ``PFB1``, bytes of an id, block length (u32), documents, ids,
blocks, exceptions (u64 each); document ids (i64), document starts (u64, one more than
documents); per block its byte place in the packed part (u64, one more than blocks),
minimum (u32), width (u8), first exception (u64, one more than blocks); exception positions
in the block (u16) and values (u32); the packed part.

Documents are dealt to tasks by ranges of their ids and sorted in each, so files follow each
other in order of (shard, file). A file ends with the document that reaches ``file_ids``
ids, which bounds what a task holds by that and one document. The files are the rows of a
Parquet table in the shared folder, so they are written and read through Spark's own
readers and writers wherever that folder is, and a task that runs again replaces its own.

``saved`` puts them down as files of their own in a folder of any file system that Arrow reaches.

Cases: a null or empty text has the end id alone; a very long text is one document, whole in its
file; documents of one id keep their rows, in no
order among themselves but that of the table; a null id comes first; an empty table gives no file and no rows; further
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import FastEncoder, known_id, shown_id, slices, tidy
from folioforge.plans.scratch import written

MAGIC = b"PFB1"
BLOCK = 256
PERCENTILE = 90.0
FILE_IDS = 4_000_000
END_ID = 0
HEAD = struct.Struct("<4sBxxxIQQQQ")


@lru_cache(maxsize=2)
def encoder(path: str) -> FastEncoder:
    return FastEncoder(path)


def _widths(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values in ``width`` bits each, the lowest first: bytes by row."""
    rows, n = values.shape
    if width > 16 or n % 8:
        bits = np.empty((rows, n, width), np.uint8)
        for j in range(width):
            bits[:, :, j] = (values >> np.uint32(j)) & np.uint32(1)
        return np.packbits(bits.reshape(rows, -1), axis=1, bitorder="little")
    # Eight values make ``width`` bytes: four of them in a word each, the second shifted behind the first.
    v = values.reshape(rows, n // 8, 2, 4).astype(np.uint64)
    shift = np.uint64(width)
    half = v[..., 0] | v[..., 1] << shift | v[..., 2] << (shift * np.uint64(2)) | v[..., 3] << (shift * np.uint64(3))
    words = np.empty((rows, n // 8, 2), "<u8")
    if width == 16:
        words[...] = half
    else:
        words[..., 0] = half[..., 0] | half[..., 1] << np.uint64(4 * width)
        words[..., 1] = half[..., 1] >> np.uint64(64 - 4 * width)
    return words.view(np.uint8).reshape(rows, n // 8, 16)[:, :, :width].reshape(rows, -1)


def pack(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, id_bytes: int = 2, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A file of ``ids``; ``starts`` has the first id of each document and, last, their number."""
    n = len(ids)
    blocks = -(-n // block)
    padded = np.zeros(blocks * block, np.uint32)
    padded[:n] = ids
    if n % block:
        padded[n:] = padded[n - 1]
    grid = padded.reshape(blocks, block)
    least = grid.min(1) if blocks else np.zeros(0, np.uint32)
    delta = grid - least[:, None]
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    chosen = np.partition(delta, rank, 1)[:, rank] if blocks else np.zeros(0, np.uint32)
    width = _widths(chosen)
    over = delta >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0
    over[width >= 32] = False
    row, col = np.nonzero(over)
    values = delta[row, col]
    first = np.searchsorted(row, np.arange(blocks + 1))
    delta[row, col] = 0
    sizes = (width * block + 7) // 8
    places = np.concatenate(([0], np.cumsum(sizes)))
    body = np.zeros(int(places[-1]), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 2048)) if w else []:
            packed = _packed(delta[part], w)
            body[places[part][:, None] + np.arange(packed.shape[1])] = packed
    head = HEAD.pack(MAGIC, id_bytes, block, len(doc_ids), n, blocks, len(values))
    parts = [doc_ids.astype("<i8"), starts.astype("<u8"), places.astype("<u8"), least.astype("<u4"), width.astype("<u1"), first.astype("<u8"), col.astype("<u2"), values.astype("<u4"), body]
    return head + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """A file that ``pack`` made; ``doc_ids`` and ``starts`` as given there."""

    def __init__(self, data: bytes):
        magic, self.id_bytes, self.block, docs, self.n, self.blocks, exceptions = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no token file")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.starts = take("<i8", docs), take("<u8", docs + 1).astype(np.int64)
        self.places, self.least, self.width = take("<u8", self.blocks + 1).astype(np.int64), take("<u4", self.blocks), take("<u1", self.blocks).astype(np.int64)
        self.first, self.position = take("<u8", self.blocks + 1).astype(np.int64), take("<u2", exceptions)
        self.value, self.body = take("<u4", exceptions), np.frombuffer(data, np.uint8, offset=at)
        if len(self.body) != (self.places[-1] if self.blocks else 0):
            raise ValueError("a cut token file")
        padded = np.concatenate((self.body, np.zeros(8, np.uint8)))
        self.windows = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive), from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-end // self.block)
        grid = np.zeros((b - a, self.block), np.uint32)
        width = self.width[a:b]
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            for part in np.array_split(rows, max(1, len(rows) // 2048)) if w else []:
                at = np.arange(self.block) * w
                # Eight bytes from the one in which an id begins hold all of it, as it has 32 bits at most.
                words = self.windows[self.places[a + part][:, None] + (at >> 3)]
                grid[part] = (words >> (at & 7).astype(np.uint64)) & np.uint64((1 << w) - 1)
        lo, hi = self.first[a], self.first[b]
        owner = np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1]))
        grid[owner, self.position[lo:hi]] = self.value[lo:hi]
        return (grid + self.least[a:b, None]).reshape(-1)[start - a * self.block : end - a * self.block]


def write_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the token files and return their table: ``shard, file, first_doc, n_docs, n_ids, data``."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, file = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        ids_of: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        n = 0

        def made() -> pa.RecordBatch:
            doc_ids, lengths = np.concatenate(ids_of), np.concatenate(sizes)
            data = pack(np.concatenate(held), doc_ids, np.concatenate(([0], np.cumsum(lengths))), enc.dtype.itemsize)
            row = [shard, file, int(doc_ids[0]), len(doc_ids), int(lengths.sum())]
            return pa.record_batch([*[pa.array([v], pa.int64()) for v in row], pa.array([data], pa.binary())], ["shard", "file", "first_doc", "n_docs", "n_ids", "data"])

        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                ids, offsets = enc.encode_column(batch.column(1))
                lengths = np.diff(offsets) + 1
                out = np.full(int(lengths.sum()), end_id, np.uint32)
                stops = np.cumsum(lengths)
                keep = np.ones(len(out), bool)
                keep[stops - 1] = False
                out[keep] = ids
                names = np.asarray(batch.column(0), np.int64)
                begin, done = 0, 0
                while begin < len(names):
                    # Up to the document that fills the file.
                    end = min(len(names), int(np.searchsorted(stops, done + file_ids - n, side="left")) + 1)
                    held.append(out[done : stops[end - 1]])
                    ids_of.append(names[begin:end])
                    sizes.append(lengths[begin:end])
                    n += int(stops[end - 1] - done)
                    begin, done = end, int(stops[end - 1])
                    if n >= file_ids:
                        yield made()
                        file, n = file + 1, 0
                        held.clear(), ids_of.clear(), sizes.clear()
        if ids_of:
            yield made()
        tidy()

    texts = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"))
    # Rows of one id, and those without any, are told apart by their place in the table, so that no range need hold
    # them all; the sample of the ranges then reads no text.
    texts = texts.withColumn("place", F.monotonically_increasing_id())
    dealt = texts.repartitionByRange(shards, "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    return written(dealt.mapInArrow(run, "shard long, file long, first_doc long, n_docs long, n_ids long, data binary"), "tokens")


def read_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32, shard, file``."""
    ahead = (Window.unboundedPreceding, -1)
    # One row per shard, then one per file of a shard, without the data.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*ahead)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("file").rowsBetween(*ahead)), F.lit(0))
    begins = files.select("shard", "file", inside.alias("inside")).join(shards, "shard").select("shard", "file", (F.col("first") + F.col("inside")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "file", "data")), strict=True):
                file = TokenFile(data)
                starts, crcs = file.starts, np.empty(len(file.doc_ids), np.int64)
                done = 0
                while done < len(crcs):  # a stretch of whole documents at a time
                    end = min(len(crcs), max(done + 1, int(np.searchsorted(starts, starts[done] + (1 << 20), side="right")) - 1))
                    raw = memoryview(file.read(int(starts[done]), int(starts[end])).astype("<u4").tobytes())
                    at = ((starts[done : end + 1] - starts[done]) * 4).tolist()
                    crcs[done:end] = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    done = end
                n = len(crcs)
                yield pa.record_batch([pa.array(file.doc_ids), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs), pa.array(np.full(n, shard)), pa.array(np.full(n, number))], ["doc_id", "within", "n_tokens", "ids_crc32", "shard", "file"])

    rows = files.select("shard", "file", "data").mapInArrow(run, "doc_id long, within long, n_tokens long, ids_crc32 long, shard long, file long")
    return rows.join(begins, ["shard", "file"]).select(shown_id(F.col("doc_id")).alias("doc_id"), (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "file")


def saved(files: DataFrame, folder: str) -> DataFrame:
    """Write each file as ``shard-file.pfb1`` to ``folder`` (an address) and return ``shard, file, name, bytes``.

    A file gets its name when it is whole, so a task that runs again replaces its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            shards, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names, sizes = [f"{s:06}-{n:06}.pfb1" for s, n in zip(shards, numbers, strict=True)], []
            for name, data in zip(names, batch.column(2).to_pylist(), strict=True):
                part = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, f"{base}/{name}")
                sizes.append(len(data))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["shard", "file", "name", "bytes"])

    return files.select("shard", "file", "data").mapInArrow(run, "shard long, file long, name string, bytes long")
