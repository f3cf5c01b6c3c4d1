"""Which of many passages occur verbatim in which of many texts.

Grams of bytes are winnowed: of any ``window`` grams next to each other the least by hash is an
anchor, so whatever a passage and a text that holds it share at the length of ``gram + window - 1``
bytes, they share an anchor of. Passages of like length, within a factor of two, go together, with
grams and windows of half that length each. Texts send the anchors that some passage has; each
passage is then looked for by the one of its anchors that is in the fewest texts, and what meets
there is compared in full. No passage meets a text without a common anchor, so there is no nested
loop, and no limit on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.scratch import written

#: Distinct anchors of passages that a broadcast set of them may have; with more, texts send all of theirs.
MOST_KNOWN = 1 << 20
ODD = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes next to each other, by sums of powers modulo 2^64."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(len(data) - gram + 1, np.uint64), 1
    if gram <= 16:
        for j in range(gram):
            out += (data[j : j + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(factor)
            factor = factor * ODD % (1 << 64)
    else:
        powers = np.full(len(data) + 1, ODD, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(len(out), pow(ODD, -1, 1 << 64), np.uint64)
        back[0] = 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)))
        out = (total[gram:] - total[:-gram]) * np.multiply.accumulate(back)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Distinct hashes of the least gram of each window."""
    hashes = gram_hashes(data, gram)
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    # Least of windows of doubling length, then of two that cover the whole window.
    low, long = hashes, 1
    while 2 * long <= window:
        low, long = np.minimum(low[:-long], low[long:]), 2 * long
    n = len(hashes) - window + 1
    return np.unique(np.minimum(low[:n], low[window - long : window - long + n]))


def shape(scale: int) -> tuple[int, int]:
    """Gram and window for passages of ``scale`` bytes and more, up to twice as many."""
    return max(1, scale // 2), scale - max(1, scale // 2) + 1


def _anchored(rows: DataFrame, scales: list[int] | None, known: object = None) -> DataFrame:
    """``id, scale, anchor`` of ``id, body``: at the given scales, or each row at its own; of ``known`` anchors only."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else known.value
        for batch in batches:
            at, scale_of, found = [], [], []
            for i, body in enumerate(batch.column("body").to_pylist()):
                data = np.frombuffer((body or "").encode(), np.uint8)
                for scale in scales if scales is not None else [1 << len(data).bit_length() - 1] if len(data) else []:
                    made = anchors(data, *shape(scale))
                    if wanted is not None:
                        made = made[np.isin(made, wanted, assume_unique=True)]
                    at.append(np.full(len(made), i))
                    scale_of.append(np.full(len(made), scale))
                    found.append(made)
            if at:
                yield pa.record_batch([batch.column("id").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scale_of).astype(np.int64)), pa.array(np.concatenate(found).view(np.int64))], ["id", "scale", "anchor"])

    return rows.mapInArrow(run, f"id {kind}, scale long, anchor long")


def occurrences(texts: DataFrame, passages: DataFrame, text_id: str, text: str, passage_id: str, passage: str) -> DataFrame:
    """The pairs ``passage_id, text_id`` of which the text contains the passage; ids are unique on either side.

    A null or empty passage is in no text.
    """
    spark = texts.sparkSession
    bodies = texts.select(F.col(text_id).alias("id"), F.col(text).alias("body"))
    asked = passages.where(F.length(passage) > 0).select(F.col(passage_id).alias("id"), F.col(passage).alias("body"))
    of_passages = written(_anchored(asked, None), "passage-anchors")
    scales = [r[0] for r in of_passages.select("scale").distinct().collect()]  # powers of two: some thirty at most
    distinct = of_passages.select("anchor").distinct()
    some = distinct.limit(MOST_KNOWN + 1).collect()
    known = spark.sparkContext.broadcast(np.array([r[0] for r in some], np.int64).view(np.uint64)) if len(some) <= MOST_KNOWN else None
    of_texts = written(_anchored(bodies, scales, known), "text-anchors")
    held = of_texts.groupBy("scale", "anchor").agg(F.count(F.lit(1)).alias("n"))
    counted = of_passages.join(held, ["scale", "anchor"], "left").groupBy("id", "scale").agg(F.min_by("anchor", F.struct(F.coalesce("n", F.lit(0)), "anchor")).alias("anchor"))
    met = of_texts.withColumnRenamed("id", "text").join(counted, ["scale", "anchor"]).select("id", "text")
    pairs = met.join(asked, "id").join(bodies.select(F.col("id").alias("text"), F.col("body").alias("whole")), "text")
    return pairs.where(F.contains("whole", "body")).select(F.col("id").alias(passage_id), F.col("text").alias(text_id))
