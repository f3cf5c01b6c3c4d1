"""URL filter: host and path rules, then a path-template tree judged by labelled purity.

Addresses without a rule are judged by their host's template. A path's segments are first
reduced to a skeleton: those with a digit vary from page to page and become wildcards. The
tree is then grown level by level over the counted skeletons, never over the pages, down to
the deepest: below each node a segment stays literal if a few pages have it, and if the
labelled share of bad pages below it differs from that of its siblings beyond chance,
whatever part of the node it is; all other branches are merged into one wildcard. A node of
too few pages or of one skeleton can't branch and is closed at once, so there are as many
levels as shared paths have, not as the longest path, and only open skeletons are read again.

A template's bad share is smoothed towards its host's, and that towards the whole table's.
The template is rejected if this share stands above the table's by more than ``Z_REJECT``
standard errors: the limit follows the labelled base rate, and a template of few labels needs
more of them bad. A share whose lower end is above ``MAJORITY`` is rejected at any base rate, and
a template whose own labels are no worse than the table's never is.

All is DataFrame arithmetic. Counts are summed before any shuffle, so a hot host costs one
row per skeleton and task; pages meet their template in one join that may be split.

Cases: a null address, or one without ``://``, has an empty host and path and no rule, and is
judged like any other host; a very long address is one skeleton of all its segments; an empty
table gives no rows; repeated rows, and those without an id, count and stay; labels of unknown
pages are ignored, and several labels of one page count as one, bad if any is; without labels
nothing is rejected; further columns of the pages and labels are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import ascii_lower
from folioforge.plans.scratch import written

#: (verdict, host, path); the longest that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEAST_PAGES = 5
#: Branches differ at a two-sided chance of 5 %; templates are rejected at a one-sided one of 10 %.
Z_MERGE, Z_REJECT = 1.96, 1.2816
STRENGTH, MAJORITY = 20.0, 0.5
WILD = "*"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: tuple[tuple[str, str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def skeleton(path: Column) -> Column:
    """The path's segments, variable ones as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), WILD).otherwise(s))


def grown(counted: DataFrame) -> DataFrame:
    """Adds ``template`` to counted skeletons ``host, skeleton, pages, labelled, bad``."""
    node, sums = ["host", "template"], ("pages", "labelled", "bad")
    at = counted.withColumn("template", F.lit(""))
    done = [at.where(F.size("skeleton") == 0)]
    at, d = at.where(F.size("skeleton") > 0), 0
    while not at.isEmpty():
        level = at.withColumn("segment", F.get("skeleton", F.lit(d)))
        branches = level.groupBy(*node, "segment").agg(*[F.sum(c).alias(c) for c in sums])
        whole = branches.groupBy(*node).agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
        judged = branches.join(whole, node)
        rest_n, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.col("all_bad") / F.greatest(F.col("all_labelled"), F.lit(1))
        inverse = 1 / F.greatest(F.col("labelled"), F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))
        spread = F.sqrt(pooled * (1 - pooled) * inverse)
        apart = F.abs(F.col("bad") / F.greatest(F.col("labelled"), F.lit(1)) - rest_bad / F.greatest(rest_n, F.lit(1)))
        # Less half a page on either side, as counts are whole: a branch of few labels needs more.
        differs = (F.col("labelled") > 0) & (rest_n > 0) & (apart - inverse / 2 > Z_MERGE * spread) & (spread > 0)
        only = F.col("pages") == F.col("all_pages")
        stays = (F.col("segment") != WILD) & (F.col("pages") >= LEAST_PAGES) & (only | differs)
        literal = judged.where(stays).select(*node, "segment", F.lit(True).alias("literal"))
        level = level.join(literal, [*node, "segment"], "left")
        step = F.when(F.col("literal"), F.concat(F.lit("/"), F.col("segment"))).otherwise(f"/{WILD}")
        level = level.withColumn("template", F.concat("template", step))
        reached = level.groupBy(*node).agg(F.sum("pages").alias("__pages"), F.count(F.lit(1)).alias("__skeletons"))
        level = level.join(reached, node, "left")
        few = F.col("__pages") < LEAST_PAGES
        closes = few | (F.col("__skeletons") == 1)
        left = F.slice("skeleton", F.lit(d + 2), F.size("skeleton"))
        tail = F.concat(F.lit("/"), F.array_join(F.transform(left, lambda s: F.when(few, WILD).otherwise(s)), "/"))
        goes_on = F.size("skeleton") > d + 1
        template = F.concat("template", F.when(goes_on & closes, tail).otherwise(""))
        # A level reads the one before twice; written, it isn't planned anew for each.
        level = written(level.select(*counted.columns, template.alias("template"), (goes_on & ~closes).alias("open")), "level")
        done.append(level.where("not open").drop("open"))
        at, d = level.where("open").drop("open"), d + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", strength: float = STRENGTH, z: float = Z_REJECT, majority: float = MAJORITY) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, template, purity, limit``.

    ``labels`` has ``page_id`` (of the same kind as the pages') and ``bad`` (0 or 1). ``purity`` is
    the template's smoothed bad share, and ``limit`` what it must exceed to be rejected.
    """
    known = labels.select(F.col("page_id").alias("__label"), "bad").where("bad is not null").groupBy("__label").agg(F.max("bad").cast("long").alias("bad"))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    split = split.withColumn("skeleton", skeleton(F.col("path")))
    joined = split.join(known, F.col("page_id") == F.col("__label"), "left")
    counted = joined.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = written(grown(written(counted, "skeletons")), "tree")
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    everything = tree.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("base"))
    smoothed = lambda towards: (F.col("bad") + strength * F.col(towards)) / (F.col("labelled") + strength)
    hosts = tree.groupBy("host").agg(*sums).join(F.broadcast(everything)).select("host", "base", smoothed("base").alias("host_share"))
    shares = tree.groupBy("host", "template").agg(*sums).join(hosts, "host").withColumn("purity", smoothed("host_share"))
    error = F.sqrt(F.col("purity") * (1 - F.col("purity")) / (F.col("labelled") + strength))
    # A template whose own labels are no worse than the table's isn't rejected for its host's.
    clean = (F.col("labelled") > 0) & (F.col("bad") / F.greatest(F.col("labelled"), F.lit(1)) <= F.col("base"))
    shares = shares.withColumn("limit", F.when(clean, 1.0).otherwise(F.least("base", F.lit(majority)) + z * error))
    verdicts = written(tree.select("host", "skeleton", "template").join(shares.select("host", "template", "purity", "limit"), ["host", "template"]).select("host", "skeleton", "template", "purity", "limit"), "verdicts")
    rule, says = matched(rules, F.col("host"), F.col("path"))
    out = split.join(verdicts, ["host", "skeleton"], "left")
    own = F.when(F.col("purity") > F.col("limit"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "template", "purity", "limit")
