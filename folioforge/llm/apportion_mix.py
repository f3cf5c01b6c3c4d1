"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of all documents are the house; a block of ``block_words`` words is a seat. The
sources' targets follow their weights, no source above ``most`` times its own words. Seats
go to sources by the highest quotients target / (2 k + 1), then, in each source, to its
groups of shards, and in each group to its shards, by the same rule over their words. A
shard's quota is the words of its seats. Every document is taken whole as often as all of the
shard fit into the quota; for the rest the documents are laid end to end in an order seeded by
their ids and texts and are taken whole up to the quota's end, so that at most one document of
a shard is taken in part.

Shards keep a hot source off any one task: each has about ``shard_words`` words of one source,
so a source has as many as its size asks for, and a source's shards stand in about the root of
their number of groups, so no window ranks more than that. Rows without an id are dealt by
their texts. Only sums per source, group and shard are gathered. All is DataFrame arithmetic;
the same rows give the same mix at any partitioning.

Cases: a null or empty text has no words and is taken 0 times; a very long text is one
document, taken whole or, at a quota's end, up to its last word taken; a null source is a source of
its own, after all others; repeated rows of one id are documents of their own in ``shares``,
and in ``mixed`` each follows the one of them that is taken most; an empty table gives no
rows; further columns are kept by ``mixed`` and are not read by ``shares``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import WORD, unused
from folioforge.plans.scratch import written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 16
SHARD_WORDS = 200_000
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source (one row each) its weight and target in words, from ``source, source_size``.

    With every target at min(most * size, weight * level), the sources that stop are those
    with the least size for their weight, so one ordered running sum finds the level.
    """
    everyone = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(everyone) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("ratio", F.col("source_size") / F.col("weight"))
    ahead = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole)).withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", (F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.col("rest_weight"))
    # Level k holds if the source it starts with does not stop; the first such level is the answer.
    fits = F.when(most * F.col("ratio") >= F.col("level"), F.col("level"))
    ranked = ranked.withColumn("final", F.max(fits).over(whole))
    cap = (most * F.col("source_size")).cast("double")
    return ranked.select("source", "source_size", "weight", F.when(most * F.col("ratio") < F.col("final"), cap).otherwise(F.least(cap, F.col("weight") * F.col("final"))).alias("target"))


def seats(parties: DataFrame, by: list[str], party: list[str], claim: str, house: str) -> DataFrame:
    """Sainte-Laguë: adds ``seats`` to each party, ``house`` of them in each group ``by``.

    Every seat above a divisor of claims / (house - parties / 2) is sure, and none below one of
    claims / (house + parties / 2) is won, so only the quotients between are ranked.
    """
    group = Window.partitionBy(*by)
    n, claims = F.count(F.lit(1)).over(group), F.sum(claim).over(group)
    share = F.when(claims > 0, F.col(claim) / claims).otherwise(0.0)
    rounded = lambda x: F.greatest(F.ceil(x - 0.5), F.lit(0)).cast("long")
    sized = parties.withColumn("__n", n).withColumn("__share", share)
    sized = sized.withColumn("__low", rounded(F.col("__share") * (F.col(house) - F.col("__n") / 2.0))).withColumn("__high", (rounded(F.col("__share") * (F.col(house) + F.col("__n") / 2.0)) + 1))
    sized = sized.withColumn("__left", F.col(house) - F.sum("__low").over(group))
    offers = sized.where("__left > 0 and __share > 0").select(*by, *party, "__left", claim, F.explode(F.sequence("__low", "__high")).alias("__k"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col(claim) / (2 * F.col("__k") + 1)), *[F.col(p).isNull() for p in party], *party)
    won = offers.withColumn("__rank", F.row_number().over(order)).where("__rank <= __left").groupBy(*by, *party).agg(F.count(F.lit(1)).alias("__won"))
    keys = [*by, *party]
    won = won.select(*[F.col(k).alias(f"__w_{k}") for k in keys], "__won")
    same = [sized[k].eqNullSafe(won[f"__w_{k}"]) for k in keys]
    joined = sized.join(won, same, "left")
    return joined.select(*[sized[c] for c in parties.columns], (F.col("__low") + F.coalesce("__won", F.lit(0))).alias("seats"))


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``."""
    draw = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed))
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("draw")), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    quota = sources.withColumn("__all", F.lit(1)).withColumn("house", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    quota = seats(quota, ["__all"], ["source"], "target", "house")
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")
    # The name is never null, so that all joins below are on it.
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    quota = written(quota.select(name.alias("name"), "source_size", "target", F.col("seats").alias("source_seats"), shards.alias("shards")), "sources")
    placed = sized.withColumn("name", name).join(quota, "name")
    placed = placed.withColumn("shard", F.pmod("draw", "shards")).withColumn("group", F.floor(F.col("shard") / F.ceil(F.sqrt("shards"))).cast("long"))
    parts = written(placed.groupBy("name", "group", "shard").agg(F.sum("size").alias("part_size")), "part-sizes")
    groups = parts.groupBy("name", "group").agg(F.sum("part_size").alias("group_size")).join(quota.select("name", "source_seats"), "name")
    groups = seats(groups, ["name"], ["group"], "group_size", "source_seats").select("name", "group", F.col("seats").alias("group_seats"))
    parts = seats(parts.join(groups, ["name", "group"]), ["name", "group"], ["shard"], "part_size", "group_seats")
    # The last block of a shard may be a short one.
    quota_words = F.least(F.col("seats") * block_words, most * F.col("part_size"))
    parts = written(parts.select("name", "shard", "part_size", quota_words.alias("quota")), "parts")
    line = Window.partitionBy("name", "shard").orderBy(F.xxhash64("draw", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))
    full = lined.join(parts, ["name", "shard"])

    every = F.floor(F.col("quota") / F.col("part_size")).cast("long")
    rest = F.col("quota") - every * F.col("part_size")
    once = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    taken = F.when(F.col("part_size") > 0, every * F.col("size") + once).otherwise(0).cast("long")
    return full.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents with their own columns: whole copies, and of the one document that
    ends a shard's quota its first words up to the last one taken, cut from the text."""
    key, size, taken, part, parts = (unused(docs, n) for n in ("mix_id", "mix_size", "mix_taken", "mix_part", "mix_parts"))
    got = shares(docs, id_col, text_col, source_col, **how).where("taken > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("size").alias(size), F.max("taken").alias(taken))
    joined = docs.join(got, docs[id_col].eqNullSafe(got[key]))
    whole = F.floor(F.col(taken) / F.col(size)).cast("int")
    over = F.col(taken) % F.col(size)
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<bigint>")))
    rows = joined.withColumn(parts, copies).withColumn(part, F.explode(parts))
    words = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (F.col(part) + 1).cast("int"))
    head = F.array_join(F.slice(words, F.lit(1), F.col(part).cast("int")), "")
    return rows.withColumn(text_col, F.when(F.col(part) > 0, head).otherwise(F.col(text_col))).select(*docs.columns)
