"""What a store answers: counts, pages, totals, blobs, backups; each over whole tables at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.plans.scratch import written

# --- reading ---


def json_field(column: str, path: str, kind: str = "string") -> Column:
    """A field of a column of JSON, as ``kind``; null where it is absent."""
    return F.get_json_object(column, path).cast(kind)


def ordinals(rows: DataFrame, by: list[str], order: list[str], after: int = 0, limit: int | None = None) -> DataFrame:
    """Rows with their ``ordinal`` in each group, resumed after one: what a cursor of pages would read."""
    numbered = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = numbered.where(F.col("ordinal") > after)
    return kept if limit is None else kept.where(F.col("ordinal") <= after + limit)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place in one order over all of them, from 1: sorted by ranges in many tasks, each of
    which goes on where the ranges before it end."""
    placed = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    joined = placed.withColumn("__inside", inside).join(starts, "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next page in order of ``keys``: ``a > x or (a = x and b > y)`` and so on."""
    if after is not None:
        tests, equal = [], F.lit(True)
        for k, v in zip(keys, after, strict=True):
            tests.append(equal & (F.col(k) > v))
            equal = equal & (F.col(k) == v)
        rows = rows.where(reduce(lambda a, b: a | b, tests))
    return rows.orderBy(*keys).limit(limit)


def page_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a log, each row with the ``total`` of all."""
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row


def streamed(rows: DataFrame, at_once: int) -> Iterator[list[Row]]:
    """Rows in lists of ``at_once``, a partition at a time: the driver holds that and no more."""
    held: list[Row] = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == at_once:
            yield held
            held = []
    if held:
        yield held


# --- counting ---


def statistics(documents: DataFrame, kinds: tuple[str, ...] = ("source", "media_type", "status")) -> DataFrame:
    """``dimension, value, n``: several groupings in one pass."""
    sets = documents.groupingSets([[k] for k in kinds], *kinds).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    # A set's own column is the one whose bit isn't set, also where its value is null.
    own = [(F.col("__g").bitwiseAND(1 << (len(kinds) - 1 - i)) == 0, k) for i, k in enumerate(kinds)]
    pick = lambda of: F.coalesce(*[F.when(is_own, of(k)) for is_own, k in own])
    return sets.select(pick(F.lit).alias("dimension"), pick(F.col).alias("value"), "n")


def totals(documents: DataFrame, states: tuple[str, ...] = ("indexed", "failed")) -> DataFrame:
    """One row: documents, those of each state, and characters."""
    s = F.col("status")
    return documents.agg(F.count(F.lit(1)).alias("documents"), *[F.count_if(s == v).alias(v) for v in states], F.sum("n_chars").alias("chars"))


def state_counters(rows: DataFrame, by: str, state: str, states: tuple[str, ...]) -> DataFrame:
    """Per group one counter for each state."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(state) == v).alias(v.lower()) for v in states])


def status_counts(documents: DataFrame) -> DataFrame:
    """``status, n`` of live documents: what a question about the index is answered with."""
    return documents.where(~F.col("deleted")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def next_versions(history: DataFrame, by: str, version: Column, distinct: list[Column]) -> DataFrame:
    """Per key the next version number, and how many distinct representations it has had."""
    return history.groupBy(by).agg((F.max(version) + 1).alias("next_version"), F.count_distinct(F.concat_ws("/", *distinct)).alias("n"))


def chunk_totals(chunks: DataFrame, documents: DataFrame, by: str = "source") -> DataFrame:
    """Chunks and tokens per group of documents; counted per document before the join, so the shuffle is of counts."""
    per = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"))
    return per.join(documents.select("document_id", by), "document_id").groupBy(by).agg(F.sum("n").alias("n_chunks"), F.sum("t").alias("tokens"))


def collection_counts(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per collection its documents and their chunks, none for a document without."""
    per = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    joined = members.distinct().join(per, "document_id", "left")
    return joined.groupBy("collection_id").agg(F.count("document_id").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))


def both_counts(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """How often pairs of groups share a member."""
    return left.join(right, key).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def sum_or_zero(parents: DataFrame, children: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Each parent with the sum over its children, 0 without any."""
    per = children.groupBy(key).agg(F.round(F.sum(value), 2).alias(name))
    return parents.select(key).join(per, key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def counted_either(rows: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, either: Column) -> DataFrame:
    """Rows per left key whose left or right side meets a condition: equi-joins first, so neither side is a loop."""
    joined = rows.join(left, left_key).join(right, right_key).where(either)
    return joined.groupBy(left_key).agg(F.count(F.lit(1)).alias("n"))


# --- visibility ---


def hydrated(hits: DataFrame, visible: DataFrame) -> DataFrame:
    """Chunks of visible documents, of the publication that is theirs; others are never shown."""
    return hits.join(visible.select("document_id", "publication_id"), ["document_id", "publication_id"])


def live_fraction(chunks: DataFrame, visible: DataFrame) -> DataFrame:
    """One row ``live, stored, fraction``: how much of an index a search may show."""
    seen = visible.select("document_id", "publication_id").distinct().withColumn("__seen", F.lit(1))
    joined = chunks.select("document_id", "publication_id").join(seen, ["document_id", "publication_id"], "left")
    sums = joined.agg(F.count("__seen").alias("live"), F.count(F.lit(1)).alias("stored"))
    return sums.withColumn("fraction", F.round(F.col("live") / F.greatest("stored", F.lit(1)), 6))


def leaks(hits: DataFrame, visible: DataFrame) -> DataFrame:
    """Hits that the scope doesn't allow: a result with any is refused."""
    return hits.join(visible.select("document_id"), "document_id", "left_anti")


def outbound(chunks: DataFrame, documents: DataFrame, local: tuple[str, ...]) -> DataFrame:
    """Chunks that may leave: of known documents, none of them of a source that stays local."""
    allowed = documents.where(~F.col("source").isin(*local)).select("document_id")
    return chunks.join(allowed, "document_id", "left_semi")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only the left side has, once each."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def provenance_problems(title: Column | None, uri: Column, sections: Column | None = None, most_chars: int = 1024, most_sections: int = 32) -> Column:
    """What is wrong with a declared provenance, joined by ``+``; empty if it is accepted."""
    checks = []
    for c in (title, uri):
        if c is not None:
            checks += [F.when(F.length(c) > most_chars, "long"), F.when(c.rlike(r"[\x00-\x1f\x7f]"), "unprintable")]
    checks.insert(1, F.when(uri.isNull() | ~uri.rlike("(?i)^https?://[^/?#]+"), "uri"))
    if sections is not None:
        checks.append(F.when(F.size(sections) > most_sections, "sections"))
    return F.array_join(F.array_distinct(F.filter(F.array(*checks), lambda x: x.isNotNull())), "+")


# --- blobs and backups ---

#: Media types that are worth compressing (fixed values), besides all of ``text/``.
TEXTUAL = ("application/json", "application/xml", "application/yaml", "application/toml", "image/svg+xml")


def blobs(contents: DataFrame, content: str, order: str, most_bytes: int | None = None, media_type: str | None = None) -> DataFrame:
    """Content-addressed blobs: ``blob, first, n, size, omitted, compressed``, one per content.

    A content larger than ``most_bytes`` is known by its address but not kept, and says so.
    """
    size = F.octet_length(content)
    textual = F.lit(False) if media_type is None else F.col(media_type).startswith("text/") | F.col(media_type).isin(*TEXTUAL)
    out = contents.groupBy(F.md5(content).alias("blob")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.length(content)).alias("size"), F.min(size).alias("bytes"), F.coalesce(F.max(textual), F.lit(False)).alias("compressed"))
    omitted = F.lit(None).cast("string") if most_bytes is None else F.when(F.col("bytes") > most_bytes, "too_large")
    return out.withColumn("omitted", omitted)


def blob_bytes(records: DataFrame, by: list[str], value: str) -> DataFrame:
    """Records and bytes per blob."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.sum(value), 2), F.lit(0)).alias("bytes"))


def inventory(rows: DataFrame, key: str, content: str) -> DataFrame:
    """What a backup lists: ``key, sha256``."""
    return rows.select(key, F.sha2(content, 256).alias("sha256"))


def backup_states(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, sha256, state``: each listed or found row as same, changed, missing or new, with the listed digest."""
    f = found.select(key, F.col("sha256").alias("__now"))
    state = F.when(F.col("sha256").isNull(), "new").when(F.col("__now").isNull(), "missing").when(F.col("sha256") == F.col("__now"), "same").otherwise("changed")
    return listed.join(f, key, "full_outer").select(key, "sha256", state.alias("state"))


def restored(backup: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """Current rows with those that changed or went missing taken from the backup; new ones stay."""
    states = backup_states(inventory(backup, key, content), inventory(current, key, content), key)
    from_backup = backup.join(states.where("state in ('changed', 'missing')").select(key), key, "left_semi")
    return current.join(states.where("state = 'changed'").select(key), key, "left_anti").unionByName(from_backup)


def exported(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def imported(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines of a schema; a malformed line fails the read and is never skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def include_closure(edges: DataFrame, depth: int) -> DataFrame:
    """``src, dst, level, cycle``: what each page includes at any depth, by the shortest way, up to ``depth``.

    One join per level, over what the level before found new and wrote; ``cycle`` marks pages that
    include themselves.
    """
    new = written(edges.select("src", "dst").distinct().withColumn("level", F.lit(1)), "closure")
    levels, step = [new], edges.select(F.col("src").alias("dst"), F.col("dst").alias("__next"))
    for level in range(2, depth + 1):
        reached = new.join(step, "dst").select("src", F.col("__next").alias("dst")).distinct()
        known = reduce(DataFrame.unionByName, levels).select("src", "dst")
        new = written(reached.join(known, ["src", "dst"], "left_anti").withColumn("level", F.lit(level)), "closure")
        if new.isEmpty():
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, levels).withColumn("cycle", F.col("src") == F.col("dst"))


def gotten(asked: DataFrame, contents: DataFrame, content: str, omitted: DataFrame | None = None) -> DataFrame:
    """``blob``, the content under each address asked for, and ``state``: found, omitted (known, but not kept) or unknown.

    ``omitted`` has the addresses of what was too large to keep. An address is that of ``blobs``.
    """
    kept = contents.groupBy(F.md5(content).alias("blob")).agg(F.first(content).alias(content))
    out = asked.select("blob").distinct().join(kept, "blob", "left")
    if omitted is not None:
        out = out.join(omitted.select("blob", F.lit(True).alias("__omitted")).distinct(), "blob", "left")
    known = F.coalesce(F.col("__omitted"), F.lit(False)) if omitted is not None else F.lit(False)
    return out.select("blob", F.when(~known, F.col(content)).alias(content), F.when(known, "omitted").when(F.col(content).isNotNull(), "found").otherwise("unknown").alias("state"))


def audited(log: DataFrame, events: tuple[str, ...] = (), since: Column | None = None, actor: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of an audit log ``at, id, event, actor``, latest first, of some events, from a time on or by one actor, with the total."""
    rows = log.where(F.col("event").isin(*events)) if events else log
    rows = rows if since is None else rows.where(F.col("at") >= since)
    rows = rows if actor is None else rows.where(F.col("actor") == actor)
    return page_with_total(rows, [F.desc("at"), F.desc("id")], offset, limit)


def utility_answers(documents: DataFrame, chunks: DataFrame, embedder: str, most: int = 50) -> DataFrame:
    """``kind, text, n`` of the questions about the index itself: its latest documents, how many there are, and its state."""
    live = documents.where(~F.col("deleted"))
    listed = live.orderBy(F.desc("updated_s"), "document_id").limit(most)
    titles = listed.agg(F.array_sort(F.collect_list(F.struct((-F.col("updated_s")).alias("o"), "document_id", "title"))).alias("t"))
    names = F.array_join(F.col("t.title"), ", ")
    list_ = titles.select(F.lit("document_list").alias("kind"), F.when(F.size("t") == 0, "no documents are indexed").otherwise(F.concat(F.size("t"), F.lit(" document(s): "), names)).alias("text"), F.size("t").cast("long").alias("n"))
    count = live.agg(F.count(F.lit(1)).alias("n")).select(F.lit("document_count").alias("kind"), F.concat("n", F.lit(" document(s) are indexed")).alias("text"), "n")
    state = chunks.agg(F.count(F.lit(1)).alias("n")).select(F.lit("index_status").alias("kind"), F.concat("n", F.lit(f" chunk(s) indexed, embedded by {embedder}")).alias("text"), "n")
    return list_.unionByName(count).unionByName(state)


def union_page(sides: list[DataFrame], keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """A page of the rows that are on any side, each once, in order of ``keys``. A side sends its own page only."""
    pages = [keyset_page(side.select(*keys).distinct(), keys, after, limit) for side in sides]
    return keyset_page(reduce(DataFrame.unionByName, pages).distinct(), keys, after, limit)
