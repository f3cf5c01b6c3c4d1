"""Chunks of a budget as a plan of expressions: blocks to units, units to groups, groups to chunks.

The rules are those of ``chunking.chunk``, which works document by document in Python; here a block's
parts, the groups that fill a budget, short tails and overlaps are folds over arrays inside the engine.
A document's units meet once, in one row, by a sum over its blocks; one fold keeps where chunks begin and
never copies texts, and a chunk leaves that row with its own text alone. Tokens are words and single
marks, none of which crosses white space, so the tokens of joined units are the sum of theirs: a text is
counted when it is cut, and not again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from folioforge.functions.text import sentences
from folioforge.operators.chunking import ATOMIC, Budget

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: What overlaps: kinds whose sentences may be told again.
FLOWING = ("prose", "list")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def starts_of(items: Column, size: Callable[[Column], Column], breaks: Callable[[Column], Column], budget: Column | int) -> Column:
    """Places, from 1, at which groups begin: a group takes items as long as their sizes stay in the budget and none breaks it."""
    zero = F.lit(0)
    start = F.struct(F.array().cast("array<int>").alias("starts"), zero.alias("used"), zero.alias("at"))

    def step(acc: Column, item: Column) -> Column:
        new = (acc["at"] == 0) | breaks(item) | (acc["used"] + size(item) > budget)
        return F.struct(
            F.when(new, F.concat(acc["starts"], F.array((acc["at"] + 1).cast("int")))).otherwise(acc["starts"]).alias("starts"),
            F.when(new, size(item)).otherwise(acc["used"] + size(item)).cast("int").alias("used"),
            (acc["at"] + 1).cast("int").alias("at"),
        )

    return F.aggregate(items, start, step, lambda acc: acc["starts"])


def run_of(items: Column, start: Column, end: Column) -> Column:
    """Items from one place to before another, each taken by its place: a slice would read all items for every group."""
    return F.transform(F.sequence(start, end - 1), lambda j: F.get(items, j - 1))


def cut_at(items: Column, starts: Column) -> Column:
    """Items, which should be bound or a column, in groups that begin at the given places."""
    return bound(starts, lambda at: F.transform(at, lambda s, i: run_of(items, s, F.coalesce(F.get(at, i + 1), F.size(items) + 1))))


def sized_as(text: Column, tokens: Column) -> Column:
    return F.struct(text.alias("t"), tokens.alias("n"))


def counted(text: Column) -> Column:
    """A text beside its tokens."""
    return sized_as(text, token_count(text))


def total(items: Column, size: str) -> Column:
    return F.aggregate(items, F.lit(0), lambda n, x: n + x[size])


def hard_parts(text: Column, budget: int) -> Column:
    """As many whole words in each part as the budget takes, ``t`` beside its tokens ``n``; a word that is too long is cut between its tokens."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), counted)
    cut = lambda w: bound(F.regexp_extract_all(w, F.lit(TOKEN), F.lit(0)), lambda t: F.transform(F.sequence(F.lit(1), F.size(t), F.lit(budget)), lambda i: counted(F.array_join(F.slice(t, i, F.lit(budget)), ""))))
    sized = F.flatten(F.transform(words, lambda w: F.when(w["n"] <= budget, F.array(w)).otherwise(cut(w["t"]))))
    groups = bound(sized, lambda x: cut_at(x, starts_of(x, lambda y: y["n"], lambda y: F.lit(False), budget)))
    return F.transform(groups, lambda g: sized_as(F.array_join(F.transform(g, lambda x: x["t"]), " "), total(g, "n")))


def prose_parts(text: Column, tokens: Column, budget: int) -> Column:
    """Paragraphs that fit, else sentences that fit, else whole words; ``t`` beside its tokens ``n``."""
    kept = lambda parts: F.filter(parts, lambda p: p != "")
    paragraphs = kept(F.transform(F.split(text, "\\n[ \\t]*\\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")))
    sized = bound(paragraphs, lambda ps: F.transform(ps, lambda p: sized_as(p, F.when(F.size(ps) == 1, tokens).otherwise(token_count(p)))))
    of_sentence = lambda s: F.when(s["n"] <= budget, F.array(s)).otherwise(hard_parts(s["t"], budget))
    of_paragraph = lambda p: F.when(p["n"] <= budget, F.array(p)).otherwise(F.flatten(F.transform(F.transform(sentences(p["t"]), counted), of_sentence)))
    return F.flatten(F.transform(sized, of_paragraph))


def line_parts(text: Column, header_rows: Column, budget: int) -> Column:
    """Lines in parts of the budget, each below the header's lines; a line that is too long in parts of its own."""

    def parts(lines: Column) -> Column:
        head = F.slice(lines, F.lit(1), header_rows)
        taken = F.aggregate(head, F.lit(0), lambda n, line: n + token_count(line))
        rest = F.slice(lines, header_rows + 1, F.greatest(F.size(lines) - header_rows, F.lit(0)))
        below = lambda g, h: F.when(g[0]["long"] | (header_rows == 0), h).otherwise(F.concat(F.array_join(head, "\n"), F.lit("\n"), h))

        def grouped(room: Column) -> Column:
            short = lambda x: F.array(F.struct(x.alias("t"), token_count(x).alias("n"), F.lit(False).alias("long")))
            long = lambda x: F.transform(hard_parts(x, budget), lambda y: F.struct(y["t"].alias("t"), F.lit(budget).alias("n"), F.lit(True).alias("long")))
            sized = F.flatten(F.transform(rest, lambda x: F.when(token_count(x) <= room, short(x)).otherwise(long(x))))
            return bound(sized, lambda y: cut_at(y, starts_of(y, lambda x: x["n"], lambda x: x["long"], room)))

        made = bound(F.greatest(F.lit(budget) - taken, F.lit(1)), grouped)
        return F.transform(made, lambda g: below(g, F.array_join(F.transform(g, lambda x: x["t"]), "\n")))

    return bound(F.split(text, "\n"), parts)


def units(blocks: DataFrame, budget: Budget) -> DataFrame:
    """``document_id, position, part, kind, path, text, tokens, opens`` of ``document_id, position, kind, path, text, header_rows``,
    and of ``tokens`` where the texts are counted before.

    Headings are no units: the first one below a heading, and of a document, opens a section. A document of
    headings alone is prose.
    """
    per = Window.partitionBy("document_id")
    sized = blocks if "tokens" in blocks.columns else blocks.withColumn("tokens", token_count(F.col("text")))
    full = sized.where(F.rlike("text", F.lit(r"\S"))).withColumn("__body", F.max(F.col("kind") != "heading").over(per))
    known = full.withColumn("kind", F.when(F.col("__body"), F.col("kind")).otherwise("prose"))
    before = F.lag("kind").over(per.orderBy("position"))
    marked = known.withColumn("opens", before.isNull() | (before == "heading")).where("kind <> 'heading'")
    most, text, tokens = budget.text, F.col("text"), F.col("tokens")
    lines = F.transform(line_parts(text, F.when(F.col("kind") == "table", F.col("header_rows")).otherwise(0), most), counted)
    parts = F.when(tokens <= most, F.array(sized_as(text, tokens))).when(F.col("kind").isin(*ATOMIC), lines).otherwise(prose_parts(text, tokens, most))
    each = marked.select("document_id", "position", "kind", "path", "opens", F.posexplode(parts).alias("part", "p"))
    return each.select("document_id", "position", "part", "kind", "path", F.col("p.t").alias("text"), F.col("p.n").alias("tokens"), (F.col("opens") & (F.col("part") == 0)).alias("opens"))


def overlap_of(before: Column, room: Column) -> Column:
    """The last sentences of a text that fit ``room`` tokens together, joined by blanks."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        full = acc["full"] | (acc["used"] + token_count(s) > room)
        return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + token_count(s)).alias("used"), F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), full.alias("full"))

    fits = lambda back: F.slice(back, F.lit(1), F.aggregate(back, start, step, lambda acc: acc["n"]))
    return F.array_join(F.reverse(bound(F.reverse(sentences(before)), fits)), " ")


def chunk_starts(u: Column, path: DataType, budget: Budget) -> Column:
    """Places, from 1, at which the chunks of a document's units begin, by one fold: units fill a group until the budget, an
    opening, an atomic unit or another path ends it; a group that ends then joins the chunk before, or is the next one."""
    none = F.array().cast("array<string>")
    no_path, zero = F.lit(None).cast(path), F.lit(0)
    group = F.struct(zero.alias("start"), zero.alias("n"), F.lit(False).alias("opens"), none.alias("kinds"), no_path.alias("path"))
    last = F.struct(F.array().cast("array<int>").alias("starts"), zero.alias("n"), none.alias("kinds"), no_path.alias("path"))
    atomic = lambda kind: kind.isin(*ATOMIC)

    def closed(c: Column, g: Column) -> Column:
        """The chunks ``c`` after a group that has ended."""
        joins = (F.size(c["starts"]) > 0) & (g["n"] < budget.least) & ~g["opens"] & (c["n"] + g["n"] <= budget.text) & (c["kinds"] == g["kinds"]) & ~atomic(g["kinds"][0]) & c["path"].eqNullSafe(g["path"])
        one = lambda starts, n: F.struct(starts.alias("starts"), n.cast("int").alias("n"), g["kinds"].alias("kinds"), g["path"].alias("path"))
        return F.when(joins, one(c["starts"], c["n"] + g["n"])).otherwise(one(F.concat(c["starts"], F.array(g["start"])), g["n"]))

    def step(acc: Column, x: Column) -> Column:
        at, g = acc["at"] + 1, acc["g"]
        new = (acc["at"] == 0) | x["opens"] | (g["n"] + x["tokens"] > budget.text) | atomic(x["kind"]) | atomic(g["kinds"][0]) | ~x["path"].eqNullSafe(g["path"])
        begun = F.struct(at.alias("start"), x["tokens"].alias("n"), x["opens"].alias("opens"), F.array(x["kind"]).alias("kinds"), x["path"].alias("path"))
        kinds = F.when(F.array_contains(g["kinds"], x["kind"]), g["kinds"]).otherwise(F.array_sort(F.concat(g["kinds"], F.array(x["kind"]))))
        grown = F.struct(g["start"].alias("start"), (g["n"] + x["tokens"]).alias("n"), g["opens"].alias("opens"), kinds.alias("kinds"), g["path"].alias("path"))
        state = lambda c, g: F.struct(at.alias("at"), c.alias("c"), g.alias("g"))
        return F.when(new, state(F.when(acc["at"] == 0, acc["c"]).otherwise(closed(acc["c"], g)), begun)).otherwise(state(acc["c"], grown))

    return F.aggregate(u, F.struct(zero.alias("at"), last.alias("c"), group.alias("g")), step, lambda acc: closed(acc["c"], acc["g"])["starts"])


def chunks(blocks: DataFrame, budget: Budget = Budget()) -> DataFrame:  # noqa: B008
    """``document_id, position, text, kind, path, token_count`` of blocks as ``units`` takes them: units of one section and
    path fill the text budget; a group below ``budget.least`` joins the one before if it fits; flowing text begins with
    the last sentences of the chunk before, ``budget.overlap`` tokens and half of it at most."""
    u = F.col("u")
    per = units(blocks, budget).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "part", "text", "kind", "path", "tokens", "opens"))).alias("u"))
    placed = per.withColumn("starts", chunk_starts(u, blocks.schema["path"].dataType, budget))
    body = lambda x: F.array_join(F.transform(x, lambda y: y["text"]), "\n\n")

    def dominant(x: Column) -> Column:
        of = lambda k: F.aggregate(x, F.lit(0), lambda n, y: n + F.when(y["kind"] == k, y["tokens"]).otherwise(0))
        weight = lambda kinds: F.transform(kinds, lambda k, i: F.struct(of(k).alias("n"), (-i).alias("first"), k.alias("kind")))
        return F.array_max(weight(F.array_distinct(F.transform(x, lambda y: y["kind"]))))["kind"]

    def before(x: Column, s: Column, i: Column) -> Column:
        """The text whose end a chunk begins with, and the room for it; null if it begins with its own."""
        last = u[s - 2]
        flows = (i > 0) & ~x[0]["opens"] & x[0]["kind"].isin(*FLOWING) & last["kind"].isin(*FLOWING)
        room = lambda y: F.least(F.lit(budget.overlap), F.floor(total(y, "tokens") / 2).cast("int"), F.lit(budget.text) - total(x, "tokens"))
        told = bound(run_of(u, F.get("starts", i - 1), s), lambda y: F.struct(body(y).alias("text"), room(y).alias("room")))
        return F.when(flows, told)

    def chunk(x: Column, s: Column, i: Column) -> Column:
        own = [body(x).alias("text"), dominant(x).alias("kind"), x[0]["path"].alias("path"), total(x, "tokens").alias("n")]
        return F.struct(*own, *([before(x, s, i).alias("before")] if budget.overlap > 0 else []))

    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size(u) + 1)
    made = F.transform("starts", lambda s, i: bound(run_of(u, s, end(i)), lambda x: chunk(x, s, i)))
    each = placed.select("document_id", F.posexplode(made).alias("position", "c")).select("document_id", "position", "c.*")
    if budget.overlap > 0:
        lead = F.when(F.col("before.room") > 0, overlap_of(F.col("before.text"), F.col("before.room"))).otherwise("")
        led = each.withColumn("lead", lead)
        each = led.withColumn("text", F.when(F.col("lead") != "", F.concat("lead", F.lit("\n\n"), "text")).otherwise(F.col("text"))).withColumn("n", F.col("n") + token_count(F.col("lead")))
    return each.select("document_id", "position", "text", "kind", "path", F.col("n").alias("token_count"))
