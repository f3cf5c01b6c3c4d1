"""Corpus management: filters, membership, versions, trash, relations, set and table operations.

Everything is relational and lazy. What the store of a single machine does by statements in
order is expressed as a fold over an event table or as one anti- or semi-join.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class UnsupportedFilter(ValueError):
    """A restriction that the asked table can't apply; it is refused, never dropped."""


@dataclass(frozen=True)
class Filter:
    """Fields are joined by AND, the values of one field by OR; an empty tuple restricts nothing."""

    sources: tuple[str, ...] = ()
    media_types: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    document_ids: tuple = ()
    updated_after: int | None = None
    updated_before: int | None = None
    matches_nothing: bool = field(default=False)

    COLUMNS = {"sources": "source", "media_types": "media_type", "statuses": "status", "langs": "lang", "kinds": "kind", "document_ids": "document_id"}

    def given(self) -> list[str]:
        return [f.name for f in fields(self) if f.name != "matches_nothing" and getattr(self, f.name) not in ((), None)]

    def predicate(self, supported: tuple[str, ...] | None = None) -> Column:
        """As a Column; a field outside ``supported`` raises."""
        if self.matches_nothing:
            return F.lit(False)
        refused = [n for n in self.given() if supported is not None and n not in supported]
        if refused:
            raise UnsupportedFilter(f"can't restrict by {', '.join(refused)}")
        out = F.lit(True)
        for name in self.given():
            value = getattr(self, name)
            if name == "updated_after":
                out = out & (F.col("updated_s") > value)
            elif name == "updated_before":
                out = out & (F.col("updated_s") < value)
            else:
                out = out & F.col(self.COLUMNS[name]).isin(*value)
        return out


VECTOR_FIELDS = ("document_ids", "kinds", "langs")


def listed(documents: DataFrame, filter: Filter, limit: int, offset: int = 0) -> DataFrame:
    """Live documents, latest first."""
    return documents.where(~F.col("deleted")).where(filter.predicate()).orderBy(F.desc("updated_s"), "document_id").offset(offset).limit(limit)


def regime(documents: DataFrame, filter: Filter, needs_join: bool, most: int = 1000) -> DataFrame:
    """How a filter meets a vector search: one row ``regime, n`` (counted to one past ``most``)."""
    found = documents.where(~F.col("deleted")).where(filter.predicate()).limit(most + 1).agg(F.count(F.lit(1)).alias("n"))
    told = F.when(F.col("n") == 0, "empty").when(F.col("n") <= most, "prefilter").otherwise("postfilter")
    return found.select((told if needs_join else F.lit("unresolved")).alias("regime"), "n")


def members(manual: DataFrame, ruled: DataFrame) -> DataFrame:
    """``collection_id, document_id``: by hand or by rule."""
    return manual.select("collection_id", "document_id").union(ruled.select("collection_id", "document_id")).distinct()


def in_all(memberships: DataFrame, key: str, wanted: tuple) -> DataFrame:
    """Documents that have every one of ``wanted``."""
    return memberships.where(F.col(key).isin(*wanted)).groupBy("document_id").agg(F.count_distinct(key).alias("n")).where(F.col("n") == len(set(wanted))).select("document_id")


def scoped(dimensions: list[DataFrame]) -> DataFrame:
    """Documents in each of several sets."""
    out = dimensions[0].select("document_id").distinct()
    for d in dimensions[1:]:
        out = out.join(d.select("document_id"), "document_id", "left_semi")
    return out


def change_kinds(old: DataFrame, new: DataFrame, parts: dict[str, list[str]], key: str = "document_id") -> DataFrame:
    """``key, changed`` with the names of the parts that moved, null-safe; rows only in one side are new or gone."""
    n = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for cs in parts.values() for c in cs], F.lit(1).alias("__in"))
    joined = old.withColumn("__was", F.lit(1)).join(n, key, "full_outer")
    moved = [F.when(~_all_same(cs), F.lit(name)) for name, cs in parts.items()]
    state = F.when(F.col("__was").isNull(), F.lit("new")).when(F.col("__in").isNull(), "gone").otherwise(F.concat_ws("+", *moved))
    return joined.select(key, state.alias("changed"))


def _all_same(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def stale(documents: DataFrame, current: dict[str, tuple]) -> DataFrame:
    """Documents of which a fingerprint is missing or not among the current ones."""
    bad = F.lit(False)
    for column, values in current.items():
        bad = bad | F.col(column).isNull() | ~F.col(column).isin(*values)
    return documents.where(bad)


def latest(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def versions(history: DataFrame) -> DataFrame:
    """Numbers a document's revisions where its content differs from the one before: ``document_id, at, content_hash, version``."""
    w = Window.partitionBy("document_id").orderBy("at")
    before = F.lag("content_hash").over(w)
    new = history.withColumn("__new", F.when(before.isNull() | (before != F.col("content_hash")), 1).otherwise(0))
    numbered = new.withColumn("version", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("__new = 1").select("document_id", "at", "content_hash", "version")


def citation_states(cited: DataFrame, chunks: DataFrame, documents: DataFrame, superseded: DataFrame) -> DataFrame:
    """Each cited chunk as present, superseded, deleted or unknown."""
    live = chunks.select("chunk_id", F.lit(True).alias("__has"))
    docs = documents.select("document_id", F.col("deleted").alias("__deleted"))
    old = superseded.select("document_id").distinct().withColumn("__old", F.lit(True))
    joined = cited.join(live, "chunk_id", "left").join(docs, "document_id", "left").join(old, "document_id", "left")
    state = F.when(F.col("__deleted").isNull(), "unknown").when(F.col("__deleted"), "deleted").when(F.col("__has"), "present").when(F.col("__old"), "superseded").otherwise("unknown")
    return joined.select("chunk_id", "document_id", state.alias("state"))


def related(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges read from both ends, both of which are visible: ``src, dst, kind``."""
    both = edges.select("src", "dst", "kind").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")).distinct()
    ids = visible.select("id")
    return both.join(ids, both.src == ids.id, "left_semi").join(ids, both.dst == ids.id, "left_semi")


def folded(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """The last state of each key."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state), F.max(order).alias(order))


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert without conflict: a key's first writer stays."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], insert_only: Column | None = None) -> DataFrame:
    """Merge by key: new rows replace old ones, but for those that may only be inserted."""
    n = new if insert_only is None else new.withColumn("__only", insert_only)
    if insert_only is None:
        return old.join(n.select(*keys), keys, "left_anti").unionByName(n)
    replacing, inserting = n.where(~F.col("__only")).drop("__only"), n.where("__only").drop("__only")
    kept = old.join(replacing.select(*keys), keys, "left_anti").unionByName(replacing)
    return kept.unionByName(inserting.join(kept.select(*keys), keys, "left_anti"))


def swapped(current: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """Compare and swap: ``key, revision, outcome`` of updates that expect a revision."""
    c = current.select(key, F.col("revision").alias("__now"))
    joined = proposed.join(c, key, "left")
    done = F.col("__now").eqNullSafe(F.col("expected"))
    return joined.select(key, F.when(done, F.coalesce("__now", F.lit(0)) + 1).otherwise(F.col("__now")).alias("revision"), F.when(done, "published").otherwise("superseded").alias("outcome"))


def unreferenced(blobs: DataFrame, references: list[DataFrame], key: str = "blob") -> DataFrame:
    """Blobs that none of the reference tables holds."""
    refs = references[0].select(key)
    for r in references[1:]:
        refs = refs.union(r.select(key))
    return blobs.join(refs.where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def reconciled(live: DataFrame, seen: DataFrame, key: str, most_share: float = 0.1) -> DataFrame:
    """One row: how many live rows weren't seen, their share, and whether they may be deleted unasked."""
    marked = live.select(key).join(seen.select(key).distinct().withColumn("__s", F.lit(1)), key, "left")
    sums = marked.agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("__s").isNull()).alias("missing"))
    share = F.when(F.col("live") > 0, F.col("missing") / F.col("live")).otherwise(0.0)
    return sums.select("live", "missing", F.round(share, 6).alias("share"), F.when(share > most_share, "proposed").otherwise("applied").alias("outcome"))


def stage_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stages ``name, config`` that only one side has or that differ."""
    r = right.select("name", F.col("config").alias("__config"))
    joined = left.join(r, "name", "full_outer")
    return joined.where(~F.col("config").eqNullSafe(F.col("__config"))).select("name", F.when(F.col("config").isNull(), "right").when(F.col("__config").isNull(), "left").otherwise("differs").alias("delta"))


def history_cut(messages: DataFrame, budget: int) -> DataFrame:
    """The latest messages whose tokens fit, from the end and without gaps: the first misfit ends it."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    used = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("used", used).where(F.col("used") <= budget)


def paired(messages: DataFrame) -> DataFrame:
    """User messages with the assistant's answer that comes next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("next_turn", F.lead("turn").over(w))
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("next_turn").alias("answer_turn"))


def violations(documents: DataFrame) -> DataFrame:
    """Documents that break an invariant: failed without a stage, or in need of attention without a reason."""
    failed = (F.col("status") == "failed") != F.col("failed_stage").isNotNull()
    silent = F.col("status").isin("failed", "no_extractable_text", "unsupported_media_type") & F.col("status_detail").isNull()
    return documents.select("document_id", F.concat_ws("+", F.when(failed, "failed_stage"), F.when(silent, "status_detail")).alias("broken")).where("broken <> ''")


def trash(rows: DataFrame, now: Column, grace_days: int = 30) -> DataFrame:
    """Deleted rows with the time up to which they may be restored, and whether that is over."""
    until = F.col("deleted_at") + F.make_dt_interval(F.lit(grace_days))
    return rows.withColumn("restorable_until", until).withColumn("purged", until < now)


def version_changes(history: DataFrame, fields: list[str]) -> DataFrame:
    """Revisions as ``versions`` has them, each with its ``chunk_count`` and ``changes``: for every one of ``fields`` that
    differs from the revision before, a struct of what it was and is, as text."""
    w = Window.partitionBy("document_id").orderBy("at")
    kept = history.withColumn("__before", F.lag("content_hash").over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col("content_hash")))
    told = []
    for name in fields:
        now, old = F.col(name).cast("string"), F.lag(F.col(name).cast("string")).over(w)
        told.append(F.when((F.col("version") > 1) & ~now.eqNullSafe(old), F.struct(F.lit(name).alias("key"), F.struct(old.alias("before"), now.alias("after")).alias("value"))))
    numbered = kept.withColumn("version", F.row_number().over(w)).withColumn("changes", F.map_from_entries(F.filter(F.array(*told), lambda e: e.isNotNull())))
    return numbered.select("document_id", "at", "content_hash", "version", "chunk_count", "changes")


class Rules:
    """Rules of collections by name: a document that a rule's filter accepts is a member. Names are compared without
    regard to case and runs of white space; a rule may be set anew or cleared."""

    def __init__(self) -> None:
        self.filters: dict[str, Filter] = {}

    @staticmethod
    def key(name: str) -> str:
        import unicodedata

        key = " ".join(unicodedata.normalize("NFKC", name).split()).casefold()
        if not key:
            raise ValueError("a collection needs a name")
        return key

    def set(self, name: str, rule: Filter) -> None:
        if not rule.given() and not rule.matches_nothing:
            raise ValueError("a rule that restricts nothing would take in the whole corpus")
        self.filters[self.key(name)] = rule

    def clear(self, name: str) -> bool:
        return self.filters.pop(self.key(name), None) is not None

    def members(self, documents: DataFrame) -> DataFrame:
        """``collection_id, document_id`` of all rules, in one pass over the documents."""
        names = [F.when(rule.predicate(), F.lit(name)) for name, rule in sorted(self.filters.items())]
        hit = F.filter(F.array(*names), lambda n: n.isNotNull()) if names else F.array().cast("array<string>")
        return documents.select(F.explode(hit).alias("collection_id"), "document_id")
