"""Lifecycle of a corpus: acquisition runs and their records, reconciliation, rebuilds, sweeps.

A run lists what its source has as records, fetches bodies into blobs, and is promoted when it
is complete. Records are rows ``run_id, source_id, ordinal, state`` and what a function's text
adds; runs are rows ``run_id, scope, state``. All is relational: where a store of one machine
would update rows in order, the rows here are an event table that is folded, or one anti- or
semi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which state a record may move to (fixed values); a settled one moves no more.
MOVES = {"listed": ("fetching", "unchanged", "omitted"), "fetching": ("fetched", "failed", "omitted"), "failed": ("fetching", "omitted"), "fetched": ("derived", "failed"), "derived": (), "unchanged": (), "omitted": ()}


def public_state(state: Column, hidden: dict[str, str]) -> Column:
    """A state as it is shown: those of ``hidden`` by another name."""
    out = state
    for name, shown in hidden.items():
        out = F.when(state == name, shown).otherwise(out)
    return out


def enumerated(records: DataFrame, page: DataFrame, by: tuple[str, ...] = ("run_id", "source_id")) -> DataFrame:
    """A page of listed records appended: of one source in a run the first stays, whatever comes later."""
    first = Window.partitionBy(*by).orderBy("ordinal")
    once = page.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return records.unionByName(once.join(records.select(*by), list(by), "left_anti"))


def settled(events: DataFrame, by: tuple[str, ...] = ("run_id", "source_id"), moves: dict[str, tuple[str, ...]] = MOVES) -> DataFrame:
    """The state of each record after its events ``by, seq, state``, in order; ``refused`` counts moves that the
    machine doesn't have, which leave the state as it is. A record's first event must be ``listed``."""
    allowed = F.create_map(*[x for k, v in moves.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "state")))
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("refused"))

    def step(acc: Column, event: Column) -> Column:
        good = F.when(acc["state"].isNull(), event["state"] == "listed").otherwise(F.array_contains(F.coalesce(F.try_element_at(allowed, acc["state"]), F.array().cast("array<string>")), event["state"]))
        return F.struct(F.when(good, event["state"]).otherwise(acc["state"]).alias("state"), (acc["refused"] + F.when(good, 0).otherwise(1)).alias("refused"))

    folded = events.groupBy(*by).agg(F.aggregate(ordered, start, step).alias("x"))
    return folded.select(*by, "x.state", "x.refused")


def completeness(records: DataFrame, omitted: Column, inventory: DataFrame | None = None) -> DataFrame:
    """Per run ``run_id, missing, completeness``: partial if a record is omitted, or if ``inventory``
    (``run_id, complete``) doesn't say that the listing itself was complete."""
    per = records.groupBy("run_id").agg(F.count_if(omitted).alias("missing"))
    whole = F.lit(True)
    if inventory is not None:
        per, whole = per.join(inventory.select("run_id", F.col("complete").alias("__complete")), "run_id", "left"), F.coalesce("__complete", F.lit(False))
    return per.select("run_id", "missing", F.when((F.col("missing") == 0) & whole, "complete").otherwise("partial").alias("completeness"))


def promoted(runs: DataFrame, state: DataFrame, manifests: DataFrame, watermarks: DataFrame, require_complete: bool = True) -> DataFrame:
    """What becomes of runs that ask to be promoted: ``run_id, outcome, moves_watermark``.

    ``runs`` has ``run_id, connector, scope, base_watermark, manifest``; ``state`` is that of
    ``completeness``; ``manifests`` holds the recomputed digests, ``run_id, manifest``; ``watermarks`` is
    ``connector, watermark, scope``. A partial run is refused where a complete one is required, and one
    whose digest differs always; the watermark moves only after a complete run, and only if the connector
    still stands where the run began, in the same scope.
    """
    j = runs.join(state.select("run_id", "completeness"), "run_id", "left")
    j = j.join(manifests.select("run_id", F.col("manifest").alias("__found")), "run_id", "left")
    j = j.join(watermarks.select("connector", F.col("watermark").alias("__now"), F.col("scope").alias("__scope")), "connector", "left")
    complete = F.col("completeness").eqNullSafe("complete")
    same = F.col("manifest").eqNullSafe(F.col("__found"))
    outcome = F.when(~same, "manifest_mismatch").when(~complete & F.lit(require_complete), "incomplete").otherwise("promoted")
    stands = F.col("base_watermark").eqNullSafe(F.col("__now")) & F.col("scope").eqNullSafe(F.coalesce("__scope", "scope"))
    return j.select("run_id", outcome.alias("outcome"), ((outcome == "promoted") & complete & stands).alias("moves_watermark"))


def manifest(records: DataFrame, line: Column, order: list[str], block: int = 1000) -> DataFrame:
    """Per run ``run_id, manifest, n``: a digest over the digests of its lines in blocks of ``block``, in order.

    A run's lines are sorted by the window, which may spill, and no array holds more than a block's
    lines or all blocks' digests.
    """
    placed = records.withColumn("__n", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) - 1)
    parts = placed.groupBy("run_id", F.floor(F.col("__n") / block).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))).alias("x"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("run_id", "__block", "n", F.sha2(F.array_join(F.col("x.line"), "\n"), 256).alias("digest"))
    whole = F.array_sort(F.collect_list(F.struct("__block", "digest")))
    return parts.groupBy("run_id").agg(F.sha2(F.array_join(whole.getField("digest"), "\n"), 256).alias("manifest"), F.sum("n").alias("n"))


def verified(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """``run_id, verdict``: recorded manifests against those computed anew."""
    f = found.select("run_id", F.col("manifest").alias("__found"))
    verdict = F.when(F.col("__found").isNull(), "missing").when(F.col("__found") == F.col("manifest"), "verified").otherwise("mismatch")
    return recorded.join(f, "run_id", "left").select("run_id", verdict.alias("verdict"))


def reusable(found: DataFrame, have: DataFrame, key: str = "document_id", runs: DataFrame | None = None) -> DataFrame:
    """Records whose body an earlier run has: same key and same, known version token.

    With ``runs`` (``run_id, scope, promoted_at, verified``) only the newest promoted run of the record's
    scope whose manifest verifies is asked; ``found`` then has ``scope`` and ``have`` has ``run_id``.
    """
    if runs is None:
        return found.join(have.select(key, "token"), [key, "token"], "left_semi")
    good = runs.where("verified and promoted_at is not null")
    newest = good.groupBy("scope").agg(F.max_by("run_id", F.struct("promoted_at", "run_id")).alias("run_id"))
    kept = have.join(newest, "run_id").select(key, "token", "scope").distinct()
    return found.join(kept, [key, "token", "scope"], "left_semi")


def capacity(needs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row of needs, with ``admitted`` and the names of the limits exceeded, joined by ``+``."""
    over = F.concat_ws("+", *[F.when(F.col(name) > most, name) for name, most in limits.items()])
    return needs.withColumn("exceeded", over).withColumn("admitted", F.col("exceeded") == "")


def reconcile_due(at: Column, now: Column, days: int = 7) -> Column:
    """Whether a source is to be compared with its corpus again."""
    return F.when(at.isNull() | (F.datediff(now, at) >= days), "due").otherwise("waits")


def interrupted(state: Column, in_flight: tuple[str, ...], since: Column, now: Column, stale_seconds: int = 3600) -> Column:
    """Whether a row in flight has been silent for too long and is queued again."""
    return state.isin(*in_flight) & (since + F.make_dt_interval(secs=F.lit(stale_seconds)) < now)


def not_in_inventory(live: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Live rows that a complete inventory doesn't list."""
    return live.join(seen.select(key), key, "left_anti")


def gone_count(prior: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of an earlier listing the present one lacks."""
    return not_in_inventory(prior.select(key).distinct(), now, key).agg(F.count(F.lit(1)).alias("gone"))


def releasable(runs: DataFrame, holds: list[tuple[DataFrame, str]]) -> DataFrame:
    """Runs that nothing holds: each hold is a table and the column by which it names what it holds."""
    out = runs
    for held, key in holds:
        out = out.join(held.select(key).distinct(), key, "left_anti")
    return out


def guarded(rows: DataFrame, guards: DataFrame, key: str) -> DataFrame:
    """Rows that a guard, such as a lease or an open request, names."""
    return rows.join(guards.select(key), key, "left_semi")


def refetch_parents(dependencies: DataFrame, documents: DataFrame, changed: DataFrame) -> DataFrame:
    """``parent, target``: live documents that include one of ``changed``, to be fetched again."""
    live = documents.where(~F.col("deleted")).select(F.col("document_id").alias("parent"))
    targets = changed.select(F.col("document_id").alias("target"))
    return dependencies.join(live, "parent", "left_semi").join(targets, "target", "left_semi").select("parent", "target")


def freed(blobs: DataFrame, released: DataFrame, retained: DataFrame, key: str = "blob") -> DataFrame:
    """One row ``bytes, blobs``: what goes with the released references, as nothing else retains it."""
    gone = released.select(key).distinct().join(retained.select(key), key, "left_anti")
    return blobs.join(gone, key, "left_semi").agg(F.round(F.coalesce(F.sum("bytes"), F.lit(0)), 2).alias("bytes"), F.count(F.lit(1)).alias("blobs"))


def last_good(current: DataFrame, outcomes: DataFrame, key: str = "document_id", first: str = "pub1") -> DataFrame:
    """``key, status, publication`` after a run: a failure is recorded, the last good publication stays.

    ``current`` may have ``publication``; ``outcomes`` has ``key, status, publication`` of the run.
    """
    before = F.col("__publication") if "publication" in current.columns else F.lit(None).cast("string")
    c = current.withColumnRenamed("publication", "__publication") if "publication" in current.columns else current
    j = c.join(outcomes.select(key, "status", "publication"), key, "left")
    good = F.when(F.col("status").eqNullSafe("failed"), F.lit(None).cast("string")).otherwise(F.col("publication"))
    return j.select(key, F.coalesce("status", F.lit("indexed")).alias("status"), F.coalesce(good, before, F.lit(first)).alias("publication"))


def representations(records: DataFrame, runs: DataFrame, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Distinct representations of the records of given runs, in order if one is named."""
    out = records.join(runs, "run_id").select(*columns).distinct()
    return out.orderBy(*order) if order else out


def run_blob_counts(records: DataFrame, runs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per state of a run its distinct blobs and its records that have one."""
    j = records.select("run_id", "blob").join(runs.select("run_id", "state"), "run_id").join(blobs.select("blob"), "blob")
    return j.groupBy("state").agg(F.count_distinct("blob").alias("blobs"), F.count(F.lit(1)).alias("records"))


def marker_records(markers: DataFrame, runs: DataFrame, records: DataFrame, binding: str) -> DataFrame:
    """``marker, run_id, records``: each marker with its runs, if it has any, and their records of its binding.

    Records are counted per run and binding first, so the shuffle is of counts.
    """
    per = records.groupBy("run_id", binding).agg(F.count(F.lit(1)).alias("__n"))
    j = markers.join(runs.select("marker", "run_id"), "marker", "left").join(per, ["run_id", binding], "left")
    return j.groupBy("marker", "run_id").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("records"))


def omission_reasons(events: DataFrame, *sources: Column) -> DataFrame:
    """``reason, n`` by the first source that tells one, else ``unknown``."""
    return events.groupBy(F.coalesce(*sources, F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rebuild_plan(documents: DataFrame, blobs: DataFrame, most_bytes: int, wanted: dict[str, str]) -> DataFrame:
    """What a rebuild would do with each live document: ``document_id, action, refusal``.

    ``documents`` has ``document_id, blob, deleted`` and the fingerprints named in ``wanted``; ``blobs`` has
    ``blob, bytes``. Fresh ones are kept, others derived again from their body; one whose body is missing or
    larger than ``most_bytes`` is refused with the reason, and a plan with refusals isn't run.
    """
    fresh = F.lit(True)
    for column, value in wanted.items():
        fresh = fresh & F.col(column).eqNullSafe(F.lit(value))
    j = documents.where(~F.col("deleted")).join(blobs.select("blob", "bytes"), "blob", "left")
    refusal = F.when(fresh, None).when(F.col("bytes").isNull(), "body_missing").when(F.col("bytes") > most_bytes, "body_too_large")
    action = F.when(fresh, "keep").when(refusal.isNotNull(), "refuse").otherwise("derive")
    return j.select("document_id", action.alias("action"), refusal.alias("refusal"))


def rebuild_problems(plan: DataFrame, built: DataFrame, key: str = "document_id") -> DataFrame:
    """What a built generation lacks or has too much of against its plan: ``key, problem``; empty if it may be published."""
    asked = plan.where("action <> 'refuse'").select(key)
    lacks = asked.join(built.select(key), key, "left_anti").withColumn("problem", F.lit("not_built"))
    extra = built.select(key).distinct().join(asked, key, "left_anti").withColumn("problem", F.lit("not_planned"))
    twice = built.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key, F.lit("built_twice").alias("problem"))
    return lacks.unionByName(extra).unionByName(twice)


def swept(documents: DataFrame, now: Column, grace_days: int = 30) -> DataFrame:
    """Documents with ``purged``: trashed longer than the grace period ago."""
    until = F.col("deleted_at") + F.make_dt_interval(F.lit(grace_days))
    return documents.withColumn("purged", F.coalesce(F.col("deleted") & (until < now), F.lit(False)))


def tombstones(index: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Index entries whose document is gone or deleted: what a search must not show and a sweep removes."""
    live = documents.where(~F.col("deleted")).select(key)
    return index.join(live, key, "left_anti")


def restorable(trashed: DataFrame, live: DataFrame, identity: list[str], now: Column, grace_days: int = 30) -> DataFrame:
    """``document_id, verdict`` of trashed documents: restored unless the grace period is over or a rival with the
    same identity is live."""
    rivals = live.select(*identity).distinct().withColumn("__rival", F.lit(True))
    j = trashed.join(rivals, identity, "left")
    until = F.col("deleted_at") + F.make_dt_interval(F.lit(grace_days))
    verdict = F.when(until < now, "expired").when(F.col("__rival"), "rival").otherwise("restored")
    return j.select("document_id", verdict.alias("verdict"))


def released(versions: DataFrame, cutoff: Column) -> DataFrame:
    """Versions with the bodies of those superseded before ``cutoff`` let go: the row stays, its ``blob`` is null and
    ``released`` says so, which is another thing than never having had one. The current version keeps its body.

    ``versions`` has ``document_id, version, at, blob``; a version is superseded when the next one is made.
    """
    after = F.lead("at").over(Window.partitionBy("document_id").orderBy("version"))
    gone = after.isNotNull() & (after < cutoff) & F.col("blob").isNotNull()
    marked = versions.withColumn("released", gone)
    return marked.withColumn("blob", F.when(~F.col("released"), F.col("blob")))


def impacts(references: DataFrame, blobs: DataFrame, actions: dict[str, Column]) -> DataFrame:
    """What each action would free, before any is taken: ``action, references, blobs, bytes``.

    ``references`` are rows that name a ``blob``; an action lets go of those its condition holds for, and a
    blob goes if no other reference is left. All actions are summed in one pass per blob.
    """
    hit = {name: F.coalesce(condition, F.lit(False)) for name, condition in actions.items()}
    per = references.groupBy("blob").agg(F.count(F.lit(1)).alias("__all"), *[F.count_if(c).alias(f"__n{i}") for i, c in enumerate(hit.values())])
    sized = per.join(blobs.select("blob", "bytes"), "blob", "left")
    rows = F.array(*[F.struct(F.lit(name).alias("action"), F.col(f"__n{i}").alias("let_go")) for i, name in enumerate(hit)])
    each = sized.select("__all", "bytes", F.explode(rows).alias("a")).select("a.action", "a.let_go", (F.col("a.let_go") == F.col("__all")).alias("gone"), "bytes")
    return each.groupBy("action").agg(F.sum("let_go").alias("references"), F.count_if("gone").alias("blobs"), F.coalesce(F.round(F.sum(F.when(F.col("gone"), F.col("bytes"))), 2), F.lit(0)).alias("bytes"))


def inspected(plan: DataFrame, built: DataFrame, sizes: dict[str, int], key: str = "document_id") -> DataFrame:
    """What a shadow generation holds against its plan, before it is published: ``action, planned, built, wrong_size``.

    ``plan`` has ``key, action, kind``; ``built`` ``key, size``, the size of what was made, which has to be that of its kind.
    """
    made = built.groupBy(key).agg(F.min("size").alias("__low"), F.max("size").alias("__high"))
    wanted = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])[F.col("kind")]
    j = plan.join(made, key, "left")
    bad = F.col("__low").isNotNull() & ((F.col("__low") != wanted) | (F.col("__high") != wanted))
    return j.groupBy("action").agg(F.count(F.lit(1)).alias("planned"), F.count("__low").alias("built"), F.count_if(F.coalesce(bad, F.lit(False))).alias("wrong_size"))
