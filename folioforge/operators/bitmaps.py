"""Memberships as bitmaps: collections, tags and other sets of numbered documents.

A set is a bitmap per 32,768 document numbers, made and merged by Spark's bitmap aggregates. A scope
is the union of the wanted sets of each dimension and the intersection of the dimensions; it is
computed and counted bucket by bucket, on tables some thousand times smaller than the memberships,
and spelled out as rows only where rows are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap.
BITS = 8 * 4096
#: Parts that a bucket of a set is summed in first, so that no task reads a large set alone.
SCHEMA = "dimension string, value string, bucket long, bits binary"


def built(members: DataFrame) -> DataFrame:
    """``dimension, value, bucket, bits`` of ``dimension, value, number``; rows may repeat, a null number is in no set.

    Bitmaps are partly made before the shuffle: a bucket of a set sends a bitmap per task, not its rows.
    """
    number = F.col("number").cast("long")
    return members.where("number is not null").groupBy("dimension", "value", F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def merged(bitmaps: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of bitmaps as one: memberships added."""
    both = bitmaps.unionByName(new)
    return both.groupBy("dimension", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def scoped(bitmaps: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """``bucket, bits`` of the documents in any wanted value of each dimension and in all dimensions."""
    hit = F.lit(False)
    for dimension, values in wanted.items():
        hit = hit | ((F.col("dimension") == dimension) & F.col("value").isin(*values))
    per = bitmaps.where(hit).groupBy("bucket", "dimension").agg(F.bitmap_or_agg("bits").alias("bits"))
    every = per.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("__n"))
    return every.where(F.col("__n") == len(wanted)).drop("__n")


def counted(bitmaps: DataFrame, *by: str) -> DataFrame:
    """Documents of each set, or of a scope, without their rows."""
    total = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0).cast("long")).alias("n_documents")
    return bitmaps.groupBy(*by).agg(total) if by else bitmaps.agg(total)


def numbers(bitmaps: DataFrame, *keep: str) -> DataFrame:
    """The documents of bitmaps as rows: ``number`` and the columns to keep."""
    kinds = ", ".join(f"{c} {bitmaps.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                bits = np.frombuffer(b"".join(some.column("bits").to_pylist()), np.uint8).reshape(some.num_rows, -1)
                row, place = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
                # The first bucket, of numbers from 1 on, is 1.
                number = (np.asarray(some.column("bucket"), np.int64)[row] - 1) * BITS + place + 1
                yield pa.record_batch([*[some.column(c).take(pa.array(row)) for c in keep], pa.array(number)], [*keep, "number"])

    return bitmaps.select(*keep, "bucket", "bits").mapInArrow(run, f"{kinds + ', ' if keep else ''}number long")


def shifted(number: Column) -> Column:
    """Numbers from 0 on as those from 1 on that bitmaps take."""
    return number + 1
