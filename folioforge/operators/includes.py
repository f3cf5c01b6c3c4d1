"""Splices pages into the pages that include them, to a depth, with cycles and gaps reported.

A body is cut at its markers into pieces, each a text and the page that is included after it.
Every page is a root; level by level the pieces of the page included are joined in below their
place, which is kept as an array of piece numbers along the path. In order of these arrays a
root's texts are its spliced body. One equi-join per level, over what is still open; the texts
move once, at the end. (Recursive SQL would do, but for its limit on rows.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.scratch import written

#: A marker, with the page's name as its group.
MARKER = r"\{\{include:([^{}]*)\}\}"


def pieces(pages: DataFrame, page: str, body: str, marker: str = MARKER) -> DataFrame:
    """``page, i, text, target``: the texts between markers in order, each with the page included after it."""
    cut = pages.select(F.col(page).alias("page"), F.split(body, marker).alias("texts"), F.regexp_extract_all(body, F.lit(marker), F.lit(1)).alias("targets"))
    each = cut.select("page", "targets", F.posexplode("texts").alias("i", "text"))
    return each.select("page", "i", "text", F.get("targets", F.col("i")).alias("target"))


def spliced(pages: DataFrame, page: str, body: str, depth: int = 5, marker: str = MARKER) -> tuple[DataFrame, DataFrame]:
    """``page, body`` with all includes put in, and ``page, target, reason, n`` of those left out:
    ``missing``, a ``cycle``, or ``too_deep``. Names of pages are strings and unique."""
    parts = written(pieces(pages, page, body, marker), "pieces")
    known = parts.select(F.col("page").alias("target")).distinct()
    step = parts.select(F.col("page").alias("target"), F.col("i").alias("__i"), F.col("text").alias("__text"), F.col("target").alias("__next"))
    rows = parts.select(F.col("page").alias("root"), F.array("i").alias("place"), "text", "target", F.array("page").alias("trail"))
    texts, left_out = [rows.select("root", "place", "text")], []
    open_ = rows.where("target is not null").drop("text")
    for level in range(depth + 1):
        cycle = F.array_contains("trail", F.col("target"))
        asked = open_.join(known.withColumn("__known", F.lit(True)), "target", "left")
        reason = F.when(F.col("__known").isNull(), "missing").when(cycle, "cycle")
        asked = written(asked.withColumn("reason", F.coalesce(reason, F.lit("too_deep")) if level == depth else reason).drop("__known"), "includes")
        left_out.append(asked.where("reason is not null").select("root", "target", "reason"))
        if level == depth or asked.isEmpty():
            break
        below = asked.where("reason is null").join(step, "target")
        below = written(below.select("root", F.concat("place", F.array("__i")).alias("place"), F.col("__text").alias("text"), F.concat("trail", F.array("target")).alias("trail"), F.col("__next").alias("target")), "spliced")
        texts.append(below.select("root", "place", "text"))
        open_ = below.where("target is not null").select("root", "place", "target", "trail")
    every = reduce(DataFrame.unionByName, texts).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    gaps = reduce(DataFrame.unionByName, left_out).groupBy(F.col("root").alias("page"), "target", "reason").agg(F.count(F.lit(1)).alias("n"))
    return every.select(F.col("root").alias("page"), F.array_join("t.text", "").alias("body")), gaps
