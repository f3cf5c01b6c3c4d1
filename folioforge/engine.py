"""The engine: a corpus in a directory of Parquet tables, and the verbs that work on it.

Every table is a set of immutable versions below one root, and one pointer names the current
version of all of them: a small file with a number, of which the highest counts. A write makes
new versions of the tables it changes and then the pointer with the next number, which can be
made only once. So readers see all of a write or nothing of it, a job that dies at any point
leaves the corpus as it was, and of two writers that began together the second is told that it
is superseded.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.hashing import content_hash, embedding_identity, fingerprint
from folioforge.functions.hashing import chunk_id as chunk_id_of
from folioforge.functions.hashing import document_id as document_id_of
from folioforge.operators import analytics, ann, chunking, corpus, embedding, evaluation, inverted, lifecycle, parsing, retrieval, store, trace
from folioforge.sources import filesystem


class Superseded(RuntimeError):
    """Another writer has published since this one began."""


class Incompatible(RuntimeError):
    """Stored rows were made under another fingerprint."""


@dataclass(frozen=True)
class Profile:
    """How deep a search goes; the context takes no more than there are candidates."""

    candidates: int = 50
    final_top_k: int = 8
    budget: int = 3000
    floor: float = 0.35

    def __post_init__(self) -> None:
        if self.final_top_k > self.candidates:
            raise ValueError("final_top_k is above candidates")


PROFILES = {"fast": Profile(20, 5, 1500), "balanced": Profile(), "precise": Profile(100, 12, 6000)}


@dataclass
class Engine:
    spark: SparkSession
    root: str
    workspace: str = "default"
    embed: Callable[[list[str]], np.ndarray] = field(default_factory=lambda: embedding.hashing_embedder(64))
    embed_name: str = "hashing-64"
    budget: chunking.Budget = field(default_factory=chunking.Budget)
    cached: int = 512
    cache_seconds: float = 300.0
    #: Vectors from which on searches go through a coarse index, if there is one.
    ann_least: int = 100_000
    _cache: OrderedDict = field(default_factory=OrderedDict)
    #: Calls that are kept before they are written to the logs together.
    logged: int = 64
    rules: corpus.Rules = field(default_factory=corpus.Rules)
    _calls: list = field(default_factory=list)
    _events: list = field(default_factory=list)

    # --- tables ---

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> tuple[int, dict[str, str]]:
        """The number of the current pointer (0 before the first write) and the version of each table."""
        folder, fs = self._fs(f"{self.root}/_current")
        if not fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {}
        top = max(numbers)
        return top, json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/_current/{top:012}", wholetext=True).collect()))

    def table(self, name: str) -> DataFrame | None:
        version = self.state()[1].get(name)
        return None if version is None else self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def publish(self, changes: dict[str, DataFrame], expected: int) -> int:
        """Write new versions of some tables, then the pointer that follows number ``expected``, if there is none yet."""
        now, versions = self.state()
        if now != expected:
            raise Superseded(f"{now} instead of {expected}")
        for name, rows in changes.items():
            versions[name] = uuid.uuid4().hex
            rows.write.parquet(f"{self.root}/{name}/{versions[name]}")
        return self._point(expected + 1, versions)

    def _point(self, number: int, versions: dict[str, str]) -> int:
        """The pointer is written beside its place and then given its number, which fails if that is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        made, fs = self._fs(f"{self.root}/_current/.{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        out.close()
        target, _ = self._fs(f"{self.root}/_current/{number:012}")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            files.rename(made, target, how)
        except Exception as e:
            fs.delete(made, False)
            if fs.exists(target):
                raise Superseded(f"another writer has made {number}") from e
            raise
        self._cache.clear()
        return number

    def fingerprints(self) -> dict[str, str]:
        b = self.budget
        return {"embed_fp": fingerprint({"model": self.embed_name}), "chunk_fp": fingerprint({"most": b.most, "overlap": b.overlap, "least": b.least, "reserve": b.reserve}), "parse_fp": fingerprint({"rules": 1})}

    # --- indexing ---

    def index_path(self, path: str, source: str = "files") -> dict[str, int]:
        """Take in a directory: files that are new or changed are read, parsed, chunked and embedded; the rest is only listed."""
        found = filesystem.discover(self.spark, path)
        old = self.table("documents")
        if old is not None:
            same = self._fresh(old).where(F.col("source") == source).select("source_id", "version_token")
            found = found.join(same, ["source_id", "version_token"], "left_anti")
        raw = filesystem.fetch(self.spark, path, found.drop("length"))
        rows = raw.select(F.lit(source).alias("source"), "source_id", F.col("path").alias("uri"), "media_type", "version_token", "content")
        return self.index(rows)

    def _fresh(self, documents: DataFrame) -> DataFrame:
        """Live documents that didn't fail and were made under today's fingerprints."""
        same = documents.where(~F.col("deleted") & (F.col("status") != "failed"))
        for name, value in self.fingerprints().items():
            same = same.where(F.col(name) == value)
        return same

    def index(self, raw: DataFrame) -> dict[str, int]:
        """Take in ``source, source_id, uri, media_type, version_token, content``.

        A row whose content is that already indexed under the current fingerprints is skipped; a row that
        fails is recorded and keeps its last good chunks. Chunks, vectors, history and documents are
        published together.
        """
        began, _ = self.state()
        old = self.table("documents")
        fps = self.fingerprints()
        raw = raw.withColumn("document_id", document_id_of(F.lit(self.workspace), "source", "source_id")).withColumn("content_hash", content_hash("content"))
        if old is not None:
            raw = raw.join(self._fresh(old).select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")
        parsed = parsing.parsed(raw).join(raw.drop("content"), "document_id")
        docs = parsed.select(
            "document_id", "source", "source_id", "uri", "media_type", "version_token", "content_hash", "blocks",
            F.when(F.col("status") == "parsed", "indexed").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "failed", "parse").alias("failed_stage"), F.when(F.col("detail") != "", F.col("detail")).alias("status_detail"),
            F.lit(False).alias("deleted"), F.lit(None).cast("timestamp").alias("deleted_at"), F.current_timestamp().alias("updated_at"), *[F.lit(v).alias(k) for k, v in fps.items()],
        )
        docs = self._built("incoming", docs)
        good = docs.where("status = 'indexed'")
        chunks = chunking.chunked(good.select("document_id", F.regexp_extract("source_id", "([^/]+)$", 1).alias("title"), "blocks"), self.budget)
        chunks = chunks.withColumn("chunk_id", chunk_id_of("document_id", "position", "text")).withColumn("heading_text", F.array_join("heading_path", " > ")).withColumn("identity", embedding_identity("document_id", F.lit(fps["embed_fp"]), "embed_text"))
        kept = self.table("chunks")
        chunks = self._built("building", chunks if kept is None else kept.join(good.select("document_id"), "document_id", "left_anti").unionByName(chunks))
        revisions = docs.where("status = 'indexed'").select("document_id", F.col("updated_at").alias("at"), "content_hash")
        before = self.table("history")
        rows = docs.drop("blocks")
        self.publish(
            {
                "chunks": chunks,
                "vectors": self._vectors(chunks),
                "lexical": self._lexical(chunks),
                "history": revisions if before is None else before.unionByName(revisions),
                "documents": rows if old is None else corpus.upserted(old, rows, ["document_id"]),
            },
            began,
        )
        return {r["status"]: r["count"] for r in docs.groupBy("status").count().collect()}

    def _built(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written beside the tables, for what reads them several times."""
        at = f"{self.root}/_{name}/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.parquet(at)

    def _lexical(self, chunks: DataFrame) -> DataFrame:
        """One row: where the inverted index of these chunks has been written."""
        path = f"{self.root}/_lexical/{uuid.uuid4().hex}"
        inverted.build(chunks, path)
        return self.spark.createDataFrame([(path,)], "path string")

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        """Vectors of all chunks: those whose input is the same are taken, the others made; checked before they are published."""
        embedding.require_within(chunks, self.budget.most)
        wanted = chunks.select("chunk_id", "identity", "embed_text", "document_id", "kind")
        stored = self.table("vectors")
        empty = self.spark.createDataFrame([], "chunk_id string, identity string, vector array<float>")
        made = embedding.embed_or_reuse(wanted, empty if stored is None else stored.select("chunk_id", "identity", "vector"), self.embed)
        rows = made.join(wanted.drop("embed_text"), "chunk_id").withColumn("checksum", F.lit(None).cast("string"))
        built = self._built("building", embedding.backfilled(rows))
        problems = lifecycle.rebuild_problems(wanted.select("chunk_id", F.lit("derive").alias("action")), built, "chunk_id")
        if (bad := problems.first()) is not None:
            raise Incompatible(f"a generation of vectors with faults, as {bad['chunk_id']}: {bad['problem']}")
        return built

    def reembed(self) -> None:
        """Make every vector anew beside the old ones, check them, then switch chunks, vectors and documents at once."""
        began, _ = self.state()
        fp = self.fingerprints()["embed_fp"]
        chunks = self._built("building", self.table("chunks").withColumn("identity", embedding_identity("document_id", F.lit(fp), "embed_text")))
        self.publish({"chunks": chunks, "vectors": self._vectors(chunks), "documents": self.table("documents").withColumn("embed_fp", F.lit(fp))}, began)

    def rebuild_plan(self, bodies: DataFrame, most_bytes: int = 1 << 28) -> DataFrame:
        """What a rebuild from ``bodies`` (``document_id, bytes``) would keep, derive and refuse."""
        docs = self.table("documents").withColumn("blob", F.col("document_id"))
        return lifecycle.rebuild_plan(docs, bodies.select(F.col("document_id").alias("blob"), "bytes"), most_bytes, self.fingerprints())

    def stale(self) -> DataFrame:
        """Documents made under other fingerprints than today's."""
        return corpus.stale(self.table("documents"), {k: (v,) for k, v in self.fingerprints().items()}).select("document_id", "source", "source_id")

    def checksum(self) -> dict[str, int]:
        return {r["integrity"]: r["count"] for r in embedding.integrity(self.table("vectors")).groupBy("integrity").count().collect()}

    def sweep(self, grace_days: int = 30) -> dict[str, int]:
        """Purge what has been in the trash for longer than the grace period, with its chunks and vectors."""
        began, _ = self.state()
        docs = lifecycle.swept(self.table("documents"), F.current_timestamp(), grace_days)
        kept = docs.where("not purged").drop("purged")
        out, changes = {"documents": docs.where("purged").count()}, {"documents": kept}
        for name in ("chunks", "vectors"):
            t = self.table(name)
            changes[name] = t.join(kept.select("document_id"), "document_id", "left_semi")
            out[name] = t.join(kept.select("document_id"), "document_id", "left_anti").count()
        if any(out.values()):
            self.publish(changes | {"lexical": self._lexical(changes["chunks"])}, began)
        return out

    gc = sweep

    # --- documents ---

    def visible(self) -> DataFrame:
        return self.table("documents").where("status = 'indexed' and not deleted")

    def document_list(self, filter: corpus.Filter = corpus.Filter(), limit: int = 50, offset: int = 0) -> DataFrame:  # noqa: B008
        d = self.table("documents").where(~F.col("deleted")).where(filter.predicate())
        return d.orderBy(F.desc("updated_at"), "document_id").offset(offset).limit(limit)

    def _marked(self, hit: DataFrame, deleted: bool) -> None:
        began, _ = self.state()
        d = self.table("documents").join(hit.select("document_id").distinct().withColumn("__hit", F.lit(True)), "document_id", "left")
        is_hit = F.coalesce("__hit", F.lit(False))
        now = F.current_timestamp() if deleted else F.lit(None).cast("timestamp")
        marked = d.withColumn("deleted_at", F.when(is_hit, now).otherwise(F.col("deleted_at"))).withColumn("deleted", F.when(is_hit, deleted).otherwise(F.col("deleted")))
        self.publish({"documents": marked.drop("__hit")}, began)

    def document_delete(self, ids: list[str]) -> None:
        """Into the trash, from where it may be restored."""
        self._marked(self.spark.createDataFrame([(i,) for i in ids], "document_id string"), True)

    def document_restore(self, ids: list[str], grace_days: int = 30) -> dict[str, str]:
        """Back from the trash, unless the grace period is over or a rival has the same identity: the verdict of each."""
        d = self.table("documents")
        wanted = d.where("deleted").join(self.spark.createDataFrame([(i,) for i in ids], "document_id string"), "document_id", "left_semi")
        verdicts = lifecycle.restorable(wanted, d.where("not deleted"), ["source", "source_id"], F.current_timestamp(), grace_days).collect()
        good = [(r["document_id"],) for r in verdicts if r["verdict"] == "restored"]
        if good:
            self._marked(self.spark.createDataFrame(good, "document_id string"), False)
        return {r["document_id"]: r["verdict"] for r in verdicts}

    # --- organisation ---

    def _changed(self, name: str, rows: list[tuple], schema: str, keys: list[str], add: bool) -> None:
        began, _ = self.state()
        now, new = self.table(name), self.spark.createDataFrame(rows, schema)
        if now is None:
            now = self.spark.createDataFrame([], schema)
        self.publish({name: corpus.appended(now, new, keys) if add else now.join(new, keys, "left_anti")}, began)

    def collect(self, collection: str, ids: list[str]) -> None:
        """Put documents into a collection; being there already is no error."""
        self._changed("memberships", [(collection, i) for i in ids], "collection_id string, document_id string", ["collection_id", "document_id"], True)

    def uncollect(self, collection: str, ids: list[str]) -> None:
        self._changed("memberships", [(collection, i) for i in ids], "collection_id string, document_id string", ["collection_id", "document_id"], False)

    def tag(self, ids: list[str], tags: list[str]) -> None:
        self._changed("tags", [(i, t) for i in ids for t in tags], "document_id string, tag string", ["document_id", "tag"], True)

    def untag(self, ids: list[str], tags: list[str]) -> None:
        self._changed("tags", [(i, t) for i in ids for t in tags], "document_id string, tag string", ["document_id", "tag"], False)

    def relate(self, edges: list[tuple[str, str, str]]) -> None:
        """``src, dst, kind`` of related documents, read from both ends."""
        self._changed("relations", edges, "src string, dst string, kind string", ["src", "dst", "kind"], True)

    def unrelate(self, edges: list[tuple[str, str, str]]) -> None:
        self._changed("relations", edges, "src string, dst string, kind string", ["src", "dst", "kind"], False)

    def related(self) -> DataFrame:
        return corpus.related(self.table("relations"), self.visible().select(F.col("document_id").alias("id")))

    def scope(self, collections: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> DataFrame:
        """Visible documents in any of the collections and with all of the tags."""
        out = [self.visible().select("document_id")]
        if collections:
            out.append(self.table("memberships").where(F.col("collection_id").isin(*collections)))
        if tags:
            out.append(corpus.in_all(self.table("tags"), "tag", tags))
        return corpus.scoped(out)

    def trash(self, grace_days: int = 30) -> DataFrame:
        until = F.col("deleted_at") + F.make_dt_interval(F.lit(grace_days))
        return self.table("documents").where("deleted").select("document_id", "source_id", "deleted_at", until.alias("restorable_until"), (until < F.current_timestamp()).alias("purged"))

    def reconcile(self, source: str, seen: DataFrame, most_share: float = 0.1) -> dict:
        """Trash what a source no longer has, unless that is suspiciously much."""
        live = self.table("documents").where((F.col("source") == source) & ~F.col("deleted"))
        plan = corpus.reconciled(live, seen, "source_id", most_share).first().asDict()
        if plan["outcome"] == "applied" and plan["missing"]:
            self._marked(lifecycle.not_in_inventory(live, seen, "source_id"), True)
        return plan

    def stats(self) -> DataFrame:
        return store.statistics(self.table("documents").where("not deleted"))

    def versions(self) -> DataFrame:
        return corpus.versions(self.table("history"))

    def glossary(self) -> DataFrame:
        return analytics.glossary(self.table("chunks").join(self.visible().select("document_id"), "document_id", "left_semi"))

    def export(self, path: str) -> None:
        store.exported(self.visible(), f"{path}/documents")
        store.exported(self.table("chunks").join(self.visible().select("document_id"), "document_id", "left_semi"), f"{path}/chunks")

    def import_(self, path: str) -> int:
        """Take in an export of this or another corpus: its documents and chunks replace those of the same ids.
        Returns the number of documents; their vectors are made here."""
        began, _ = self.state()
        docs, chunks = self.table("documents"), self.table("chunks")
        if docs is None:
            raise Incompatible("a corpus without tables has no schema to import into")
        new = store.imported(self.spark, f"{path}/documents", docs.schema)
        their = store.imported(self.spark, f"{path}/chunks", chunks.schema)
        together = self._built("building", chunks.join(new.select("document_id"), "document_id", "left_anti").unionByName(their))
        self.publish({"documents": corpus.upserted(docs, new, ["document_id"]), "chunks": together, "vectors": self._vectors(together), "lexical": self._lexical(together)}, began)
        return new.count()

    def backup(self, path: str) -> None:
        """The tables of one state, and an inventory of their rows' digests."""
        _, versions = self.state()
        for name in versions:
            rows = self.table(name)
            rows.write.parquet(f"{path}/{name}")
            rows.select(F.lit(name).alias("table"), F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("sha256")).groupBy("table", "sha256").count().write.mode("append").parquet(f"{path}/_inventory")

    def verify_backup(self, path: str) -> DataFrame:
        """``table, sha256, state`` of rows that the backup lacks or has too much of; empty if it is whole."""
        listed = self.spark.read.parquet(f"{path}/_inventory")
        found = []
        for r in listed.select("table").distinct().collect():
            rows = self.spark.read.parquet(f"{path}/{r[0]}")
            found.append(rows.select(F.lit(r[0]).alias("table"), F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("sha256")).groupBy("table", "sha256").count())
        now = reduce(DataFrame.unionByName, found).withColumnRenamed("count", "__now")
        joined = listed.join(now, ["table", "sha256"], "full_outer").where(~F.col("count").eqNullSafe(F.col("__now")))
        return joined.select("table", "sha256", F.when(F.col("count").isNull(), "new").otherwise("missing").alias("state"))

    def restore_backup(self, path: str) -> int:
        """The backup's tables as the next state, if the backup is whole."""
        began, _ = self.state()
        if not self.verify_backup(path).isEmpty():
            raise Incompatible("the backup differs from its inventory")
        names = [r[0] for r in self.spark.read.parquet(f"{path}/_inventory").select("table").distinct().collect()]
        return self.publish({n: self.spark.read.parquet(f"{path}/{n}") for n in names}, began)

    def set_rule(self, name: str, rule: corpus.Filter) -> None:
        """Documents that a filter accepts are members of a collection from now on."""
        self.rules.set(name, rule)

    def clear_rule(self, name: str) -> bool:
        return self.rules.clear(name)

    def collection_members(self) -> DataFrame:
        """``collection_id, document_id``: put in by hand, or accepted by a rule."""
        ruled = self.rules.members(self.visible())
        manual = self.table("memberships")
        return ruled.distinct() if manual is None else corpus.members(manual, ruled)

    def disagreement(self, other: Engine) -> DataFrame:
        """``document_id, state`` of documents that two corpora don't share."""
        mine, theirs = (e.visible().select("document_id", "content_hash") for e in (self, other))
        return evaluation.disagreement(mine, theirs)

    # --- search ---

    def search(self, queries: DataFrame, profile: str = "balanced", filter: corpus.Filter = corpus.Filter(), limit: int = 10, rerank: bool | Callable[[], retrieval.Scorer] = False, traced: trace.Trace | None = None) -> DataFrame:  # noqa: B008
        """``query_id, chunk_id, document_id, text, score, n_legs, rank`` for each of ``query_id, text``.

        Both legs see only visible rows that pass the filter, before anything is ranked. ``rerank`` may be a
        loader of a scorer of pairs; ``traced`` observes the stages.
        """
        watch = (lambda _, rows: rows) if traced is None else traced.watch
        fp = self.fingerprints()["embed_fp"]
        p = PROFILES[profile]
        docs = self.visible()
        if docs.where(F.col("embed_fp") != fp).limit(1).count():
            raise Incompatible("vectors were made under another embedding; re-embed first")
        seen = docs.where(filter.predicate(("sources", "media_types", "statuses", "document_ids"))).select("document_id")
        chunks = self.table("chunks")
        live = chunks.join(seen, "document_id", "left_semi")
        k = max(p.candidates, limit)
        index = inverted.opened(self.spark, self.table("lexical").first()["path"])
        lexical = inverted.search(index, queries, k, live.select("chunk_id")).withColumn("leg", F.lit("lexical"))
        asked = queries.select("query_id", F.col("text").alias("embed_text"))
        q = embedding.embedded(asked, self.embed).where("vector is not null").select("query_id", "vector")
        dense = self._dense(q, seen, k, p.floor).withColumn("leg", F.lit("dense"))
        legs = watch("lexical", lexical.select("query_id", "leg", "chunk_id", "score")).unionByName(watch("dense", dense.select("query_id", "leg", "chunk_id", "score")))
        fused = watch("fusion", retrieval.rrf(legs))
        if rerank:
            made = retrieval.overlap_rerank(fused, chunks, queries, k) if rerank is True else retrieval.reranked(fused, chunks, queries, k, rerank)
            fused = watch("rerank", made.withColumn("n_legs", F.lit(None).cast("long")))
        hits = watch("hits", fused.where(F.col("rank") <= limit))
        # The join is the re-check of the scope: a hit outside it has no row to be shown with.
        return hits.join(live.select("chunk_id", "document_id", "text", "token_count"), "chunk_id").select("query_id", "chunk_id", "document_id", "text", "token_count", "score", "n_legs", "rank")

    def _dense(self, queries: DataFrame, seen: DataFrame, k: int, floor: float) -> DataFrame:
        """The dense leg: over the coarse index's codes where it is of these vectors, else over all of them."""
        live = self.table("vectors").join(seen, "document_id", "left_semi").select("chunk_id", "vector")
        if self.vector_index_status() != "ready":
            return retrieval.dense_batched(live, queries, k, floor)
        held = self.table("ann").first()
        found = ann.search_coded(self.spark, ann.opened(self.spark, held["path"]), queries, k, held["probes"], held["rerank"], live)
        return found.where(F.greatest("score", F.lit(0.0)) >= floor)

    def vector_index_build(self, k: int = 10, least: float = 0.9) -> dict:
        """Build the coarse index of all vectors, and find the fewest partitions and the shallowest re-rank that
        reach a recall of ``least`` on every fiftieth vector, by a hash of its chunk (on all, where there are few)."""
        began, versions = self.state()
        path = f"{self.root}/_ann/{uuid.uuid4().hex}"
        vectors = self.table("vectors").select("chunk_id", "vector")
        index = ann.build(vectors, path=path)
        asked = vectors.where("vector is not null").select(F.col("chunk_id").alias("query_id"), "vector")
        if index.rows > 5000:
            asked = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(50)) == 0)
        probes, _ = ann.calibrated(self.spark, index, vectors, asked, k, (1 + least) / 2)
        rerank, reached = ann.calibrated_codes(self.spark, index, vectors, asked, k, probes, least)
        row = {"path": path, "vectors": versions["vectors"], "rows": index.rows, "probes": probes, "rerank": rerank, "recall": reached}
        self.publish({"ann": self.spark.createDataFrame([tuple(row.values())], "path string, vectors string, rows long, probes int, rerank int, recall double")}, began)
        return row

    def vector_index_status(self) -> str:
        """``exhaustive`` below ``ann_least`` vectors, then ``pending``, ``stale`` or ``ready``."""
        _, versions = self.state()
        if self.table("vectors").limit(self.ann_least).count() < self.ann_least:
            return "exhaustive"
        held = None if "ann" not in versions else self.table("ann").first()
        return "pending" if held is None else "ready" if held["vectors"] == versions["vectors"] else "stale"

    def ask_one(self, text: str, **how) -> list[dict]:
        """One query's hits as rows, kept for some minutes and for the corpus as it is now; each call is logged."""
        key = (self.state()[0], json.dumps(self.fingerprints(), sort_keys=True), text, tuple(sorted((k, str(v)) for k, v in how.items())))
        began = time.monotonic()
        held = self._cache.get(key)
        cached = held is not None and began - held[0] < self.cache_seconds
        if not cached:
            q = self.spark.createDataFrame([(0, text)], "query_id int, text string")
            hits = [r.asDict() for r in self.search(q, **how).orderBy("rank").collect()]
            self._cache[key] = (began, hits)
            while len(self._cache) > self.cached:
                self._cache.popitem(last=False)
        self._cache.move_to_end(key)
        hits = self._cache[key][1]
        self._log(text, str(how.get("profile", "balanced")), [h["chunk_id"] for h in hits], cached, int(1000 * (time.monotonic() - began)))
        return hits

    LOG = "query string, profile string, chunk_ids array<string>, cached boolean, response_time_ms int, created_at timestamp"
    STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    AUDIT = "at timestamp, id string, event string, actor string, subject string"

    def _log(self, *row) -> None:
        self._calls.append((*row, datetime.now(timezone.utc)))
        if len(self._calls) >= self.logged:
            self.flush()

    def audit(self, event: str, actor: str, subject: str = "") -> None:
        """Note an event for the audit log."""
        self._events.append((datetime.now(timezone.utc), uuid.uuid4().hex, event, actor, subject))
        if len(self._events) >= self.logged:
            self.flush()

    def flush(self) -> None:
        """Write what the logs hold back: one file for some calls, not for each."""
        for held, schema, name in ((self._calls, self.LOG, "_query_log"), (self._events, self.AUDIT, "_audit_log")):
            if held:
                self.spark.createDataFrame(held, schema).coalesce(1).write.mode("append").json(f"{self.root}/{name}", timestampFormat=self.STAMP)
                held.clear()

    def query_log(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """The latest queries, each with the total."""
        self.flush()
        log = self.spark.read.schema(self.LOG).json(f"{self.root}/_query_log", timestampFormat=self.STAMP)
        return store.page_with_total(log, [F.desc("created_at"), F.col("query")], offset, limit)

    def audit_log(self, events: tuple[str, ...] = (), since: datetime | None = None, actor: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """The latest events of some kinds, from a time on or by one actor, each with the total."""
        self.flush()
        folder, fs = self._fs(f"{self.root}/_audit_log")
        log = self.spark.read.schema(self.AUDIT).json(f"{self.root}/_audit_log", timestampFormat=self.STAMP) if fs.exists(folder) else self.spark.createDataFrame([], self.AUDIT)
        return store.audited(log, events, None if since is None else F.lit(since), actor, offset, limit)

    def context(self, hits: DataFrame, profile: str = "balanced") -> DataFrame:
        p = PROFILES[profile]
        return retrieval.assembled(hits, p.budget, p.final_top_k)


def folded(stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], start: DataFrame) -> DataFrame:
    """Stages in a row over candidates; their names must differ."""
    if len({n for n, _ in stages}) != len(stages):
        raise ValueError("two stages of one name")
    return reduce(lambda rows, s: s[1](rows), stages, start)
