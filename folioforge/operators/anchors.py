"""Which ranges of lines lie inside which others, without comparing all of a document's with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.plans.scratch import written


def level_of(start: Column, end: Column) -> Column:
    """The least power of two that is as long as a range: the range meets two bins of that width at most."""
    return F.ceil(F.log2((end - start + 1).cast("double"))).cast("int")


def inside(anchors: DataFrame, blocks: DataFrame, by: str = "document_id") -> DataFrame:
    """Every pair of an anchor and a block of its document with all of its lines, from columns ``start, end``
    (both inclusive) on either side; the block's are ``block_start, block_end``.

    A block stands in the one or two bins of its own length's width that it meets; an anchor looks into
    the bin of its first line at each width there is. So this is an equi-join, whatever the lengths.
    """
    sized = blocks.withColumns({"block_start": F.col("start"), "block_end": F.col("end")}).drop("start", "end").where("block_start <= block_end")
    sized = sized.withColumn("level", level_of(F.col("block_start"), F.col("block_end")))
    bin_of = lambda line: F.expr(f"shiftright({line}, level)")
    binned = written(sized.withColumn("bin", F.explode(F.array_distinct(F.array(bin_of("block_start"), bin_of("block_end"))))), "binned")
    levels = [r[0] for r in binned.select("level").distinct().collect()]  # of widths that are powers of two: 63 at most
    looks = anchors.where("start <= end").withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumn("bin", bin_of("start"))
    met = looks.where(level_of(F.col("start"), F.col("end")) <= F.col("level")).join(binned, [by, "level", "bin"])
    return met.where("block_start <= start and end <= block_end").drop("level", "bin")


def innermost(pairs: DataFrame, anchor: list[str]) -> DataFrame:
    """Of each anchor, how many blocks it lies in and the shortest of them, the first of equals."""
    by = F.struct(F.col("block_end") - F.col("block_start"), "block_start")
    best = pairs.groupBy(*anchor).agg(F.count(F.lit(1)).alias("n_blocks"), F.min_by(F.struct("block_start", "block_end"), by).alias("b"))
    return best.select(*anchor, "n_blocks", "b.block_start", "b.block_end")
