"""Exact dedup by content-defined chunk recipes.

Each text is cut where a hash of its last bytes says so, which puts equal passages into
equal chunks wherever they stand. A document's recipe is the ordered list of its chunks'
identifiers. Chunks meet by digest once, each task sending a distinct chunk once while it remembers
it (``MOST_HELD`` bytes of chunks; one that is sent again changes nothing); a digest
that turns out to stand for different bytes is no identifier. Documents meet by recipe
only, so a long document is not moved for each comparison. Documents whose recipe holds a
refuted digest meet by their whole text instead, so the result is exact at any digest size.

Cases: a null text counts as empty; empty texts are equal to each other; a text shorter
than a chunk is one chunk, and a very long one many of at most ``MAX_CHUNK`` bytes; repeated rows of one id count as copies, and all stay if theirs is the
largest; a row without an id stays only if no equal one has an id; an empty table gives no
rows; further columns are not read by ``groups`` and are kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import tidy, unused, utf8_of
from folioforge.plans.scratch import written

#: Mean distance of cut points in bytes is 2 ** CUT_BITS past MIN_CHUNK; none is longer than MAX_CHUNK.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 11, 512, 16384
MOST_HELD = 64 << 20
#: Odd multiplier of the hash of the last eight bytes (the golden ratio in 64 bits).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; one empty chunk if there is no data."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    words = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8)[: n - 7].view(), (n - 7, 8), (1, 1))
    last = np.ascontiguousarray(words).view("<u8")[:, 0]
    marks = np.flatnonzero((last * MULTIPLIER) >> np.uint64(64 - CUT_BITS) == 0) + 8
    out, start = [], 0
    for m in marks.tolist():
        while m - start > MAX_CHUNK:
            start += MAX_CHUNK
            out.append(start)
        if m - start >= MIN_CHUNK:
            out.append(m)
            start = m
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.sha256(chunk).digest()[:size]


def recipes(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """Per document its recipe, the hash of the recipe, and the hash of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys, shas = [], [], []
            for raw in utf8_of(batch.column(1)):
                text = raw.lower()  # of bytes: A-Z only
                ids = [_digest(c, digest_bytes) for c in chunks(text)]
                lists.append(ids)
                keys.append(hashlib.sha256(b"".join(ids) + len(text).to_bytes(8, "little")).digest())
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(lists, pa.list_(pa.binary())), pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["doc_id", "chunk_ids", "recipe", "text_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, chunk_ids array<binary>, recipe binary, text_sha256 string")


def refuted(docs: DataFrame, text_col: str, digest_bytes: int) -> DataFrame:
    """Digests that stand for more than one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            rows: list[tuple[bytes, bytes]] = []
            for raw in utf8_of(batch.column(0)):
                for c in chunks(raw.lower()):
                    d = _digest(c, digest_bytes)
                    if (known := met.get(d)) == c:
                        continue
                    rows.append((d, c))
                    if known is None:
                        met[d] = c
                        held += len(c)
            if held > MOST_HELD:
                met, held = {}, 0
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["digest", "chunk"])
        tidy()

    sent = docs.select(F.col(text_col)).mapInArrow(run, "digest binary, chunk binary")
    return sent.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. ``digest_bytes`` shortens the chunks'
    digests, which tests use to force refuted ones.
    """
    made = written(recipes(docs, id_col, text_col, digest_bytes), "recipes")
    bad = written(refuted(docs, text_col, digest_bytes), "refuted")
    known = made.withColumn("whole", F.lit(None).cast("string"))
    if not bad.isEmpty():
        hit = made.select("recipe", F.explode("chunk_ids").alias("digest")).distinct().join(bad, "digest", "left_semi").select("recipe").distinct()
        ids = made.join(hit, "recipe", "left_semi").select("doc_id").distinct()
        lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        exact = docs.select(F.col(id_col).cast("long").alias("doc_id"), lowered.alias("whole")).join(ids, "doc_id", "left_semi")
        rest = made.join(hit, "recipe", "left_anti").withColumn("whole", F.lit(None).cast("string"))
        exact = exact.withColumn("text_sha256", F.sha2("whole", 256)).withColumn("recipe", F.lit(None).cast("binary"))
        columns = ["doc_id", "recipe", "text_sha256", "whole"]
        known = written(rest.select(columns).unionByName(exact.select(columns)), "known")
    key = [F.col("recipe"), F.col("whole")]
    found = known.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Most documents have no copy: only groups are joined back, so hot keys are few rows' worth of work.
    several = found.where("group_size > 1").select(F.col("recipe").alias("r"), F.col("whole").alias("w"), "keep_id", "group_size")
    out = known.join(several, F.col("recipe").eqNullSafe(F.col("r")) & F.col("whole").eqNullSafe(F.col("w")), "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns; rows that repeat a kept id stay together."""
    name = unused(docs, "stay")
    stay = groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, docs[id_col].cast("long").eqNullSafe(stay[name]), "left_semi")
