import pytest
from pyspark.sql import functions as F

from folioforge.engine import Engine, Incompatible, Profile, Superseded, folded
from folioforge.operators.corpus import Filter
from folioforge.operators.trace import Trace


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("src")
    (src / "a.md").write_text("# Alpha\n\nThe Service Level Agreement (SLA) covers the northern office.\n\n## Hours\n\nOpen on Monday.")
    (src / "b.txt").write_text("The southern office keeps the archive of old maps.")
    (src / "c.html").write_text("<h1>Gamma</h1><p>Maps are lent on Friday.</p>")
    (src / "d.pdf").write_bytes(b"%PDF-1.4")
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('corpus')}")
    e.src = src
    e.counts = e.index_path(str(src))
    return e


def ask(engine, text, **how):
    return engine.search(engine.spark.createDataFrame([(1, text)], "query_id int, text string"), **how).orderBy("rank").collect()


def test_index_and_search(engine):
    assert engine.counts == {"indexed": 3, "unsupported_media_type": 1}
    hits = ask(engine, "archive maps")
    assert "archive of old maps" in hits[0]["text"] and hits[0]["rank"] == 1
    assert engine.checksum() == {"verified": engine.table("chunks").count()}
    assert {r.dimension for r in engine.stats().collect()} == {"source", "media_type", "status"}
    assert [(r.acronym, r.expansion) for r in engine.glossary().collect()] == [("SLA", "Service Level Agreement")]


def test_filters_come_before_ranks(engine):
    hits = ask(engine, "maps", filter=Filter(media_types=("text/html",)))
    assert hits and all("Friday" in h["text"] for h in hits)
    assert ask(engine, "maps", filter=Filter(matches_nothing=True)) == []


def test_unchanged_files_are_skipped_and_changed_ones_versioned(engine):
    assert engine.index_path(str(engine.src)) in ({}, {"unsupported_media_type": 1})
    (engine.src / "b.txt").write_text("The southern office has sold the archive.")
    assert engine.index_path(str(engine.src))["indexed"] == 1
    assert engine.versions().groupBy("document_id").count().agg(F.max("count")).first()[0] == 2
    first = engine.ask_one("sold archive")
    assert engine.ask_one("sold archive") is first
    assert [(r["cached"], r["total"]) for r in engine.query_log().collect()] == [(True, 2), (False, 2)]
    engine.cache_seconds = 0
    assert engine.ask_one("sold archive") is not first


def test_trash_restore_reconcile(engine):
    d = engine.document_list().where("source_id = 'c.html'").first()["document_id"]
    engine.document_delete([d])
    assert all(h["document_id"] != d for h in ask(engine, "maps")) and engine.trash().count() == 1
    engine.document_restore([d])
    assert any(h["document_id"] == d for h in ask(engine, "maps"))
    seen = engine.spark.createDataFrame([("a.md",), ("b.txt",), ("d.pdf",)], "source_id string")
    assert engine.reconcile("files", seen)["outcome"] == "proposed"
    assert engine.reconcile("files", seen, 0.5)["outcome"] == "applied" and engine.trash().count() == 1
    engine.document_restore([d])


def test_search_through_the_coarse_index(engine):
    plain = [(h["chunk_id"], h["score"]) for h in ask(engine, "maps of the office")]
    assert engine.vector_index_status() == "exhaustive"
    engine.ann_least = 1
    assert engine.vector_index_status() == "pending"
    assert engine.vector_index_build()["recall"] >= 0.9 and engine.vector_index_status() == "ready"
    assert [(h["chunk_id"], h["score"]) for h in ask(engine, "maps of the office")] == plain
    assert all("Friday" in h["text"] for h in ask(engine, "maps", filter=Filter(media_types=("text/html",))))


def test_stages_are_traced_and_a_scorer_may_be_handed_in(engine):
    t = Trace(engine.spark)
    asked = engine.spark.createDataFrame([(1, "maps of the office")], "query_id int, text string")
    found = engine.search(asked, traced=t, rerank=lambda: lambda pairs: [float(len(p)) for _, p in pairs])
    hits = sorted(found.collect(), key=lambda h: h["rank"])
    assert [h["score"] for h in hits] == sorted((float(len(h["text"])) for h in hits), reverse=True) and hits
    told = {r.stage: r.n_rows for r in t.report().collect()}
    assert list(told) == ["lexical", "dense", "fusion", "rerank", "hits"] and told["hits"] == len(hits) == told["rerank"]


def test_logs_rules_and_disagreement(engine, tmp_path):
    engine.set_rule("Text ", Filter(media_types=("text/plain",)))
    ids = {r.document_id for r in engine.visible().where("media_type = 'text/plain'").collect()}
    assert ids and {r.document_id for r in engine.collection_members().where("collection_id = 'text'").collect()} == ids
    assert engine.clear_rule("TEXT") and engine.collection_members().where("collection_id = 'text'").count() == 0
    assert engine.audit_log().count() == 0
    for i in range(3):
        engine.audit("share" if i else "delete", f"u{i % 2}", str(i))
    assert [(r.event, r.subject, r.total) for r in engine.audit_log(("share",)).collect()] == [("share", "2", 2), ("share", "1", 2)]
    assert engine.audit_log(actor="u1").count() == 1
    other = Engine(engine.spark, f"file://{tmp_path}/other")
    other.index_path(str(engine.src))
    assert engine.disagreement(other).count() == 0
    gone = other.visible().first()["document_id"]
    other.document_delete([gone])
    assert [tuple(r) for r in engine.disagreement(other).collect()] == [(gone, "missing")]


def test_reembed_and_fences(engine):
    other = Engine(engine.spark, engine.root, embed=engine.embed, embed_name="other")
    with pytest.raises(Incompatible):
        ask(other, "maps")
    assert other.stale().count() > 0
    other.ann_least = 1
    other.reembed()
    assert other.vector_index_status() == "stale" and ask(other, "maps")
    engine.ann_least = 100_000
    with pytest.raises(Superseded):
        engine.publish({"documents": engine.table("documents")}, -5)
    with pytest.raises(ValueError):
        Profile(candidates=3, final_top_k=5)
    with pytest.raises(ValueError):
        folded([("a", lambda d: d), ("a", lambda d: d)], engine.spark.range(1))


def test_a_write_that_dies_changes_nothing(engine, monkeypatch):
    """Whatever step fails, readers see the state before, and the next write goes on from it."""
    before, docs = engine.state(), engine.table("documents").count()
    raw = engine.spark.createDataFrame([("files", "new.txt", "u", "text/plain", "1", bytearray(b"The eastern office opened."))], "source string, source_id string, uri string, media_type string, version_token string, content binary")
    for step in ("_built", "_vectors", "_point"):
        with monkeypatch.context() as m:
            m.setattr(type(engine), step, lambda self, *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                engine.index(raw)
        assert engine.state() == before and engine.table("documents").count() == docs
    assert engine.index(raw) == {"indexed": 1} and engine.table("documents").count() == docs + 1
    assert engine.checksum() == {"verified": engine.table("chunks").count()}


def test_of_two_writers_one_is_superseded(engine):
    number, versions = engine.state()
    engine._point(number + 1, versions)
    with pytest.raises(Superseded):
        engine._point(number + 1, versions)
    with pytest.raises(Superseded):
        engine.publish({"documents": engine.table("documents")}, number)
    assert engine.state() == (number + 1, versions)


def test_collections_tags_and_relations(engine):
    ids = [r[0] for r in engine.visible().select("document_id").orderBy("document_id").collect()]
    engine.collect("c", ids[:2])
    engine.collect("c", ids[1:2])
    engine.tag(ids[1:], ["t", "u"])
    engine.untag(ids[2:], ["u"])
    assert [r[0] for r in engine.scope(("c",), ("t", "u")).collect()] == ids[1:2]
    engine.uncollect("c", ids[1:2])
    assert engine.scope(("c",), ("t",)).count() == 0 and engine.table("memberships").count() == 1
    engine.relate([(ids[0], ids[1], "k")])
    assert {(r.src, r.dst) for r in engine.related().collect()} == {(ids[0], ids[1]), (ids[1], ids[0])}
    engine.unrelate([(ids[0], ids[1], "k")])
    assert engine.related().count() == 0


def test_export_backup_and_restore(engine, tmp_path):
    engine.export(f"file://{tmp_path}/export")
    n = engine.table("documents").count()
    assert engine.import_(f"file://{tmp_path}/export") == engine.visible().count() and engine.table("documents").count() == n
    engine.backup(f"file://{tmp_path}/backup")
    assert engine.verify_backup(f"file://{tmp_path}/backup").count() == 0
    one = engine.visible().first()["document_id"]
    engine.document_delete([one])
    engine.restore_backup(f"file://{tmp_path}/backup")
    assert engine.visible().where(F.col("document_id") == one).count() == 1
    engine.table("tags").limit(1).write.mode("append").parquet(f"file://{tmp_path}/backup/tags")
    assert engine.verify_backup(f"file://{tmp_path}/backup").count() > 0
    with pytest.raises(Incompatible):
        engine.restore_backup(f"file://{tmp_path}/backup")


def test_sweep_and_rebuild_plan(engine):
    one = engine.visible().first()["document_id"]
    engine.document_delete([one])
    assert engine.document_restore([one], grace_days=-1) == {one: "expired"}
    assert engine.sweep()["documents"] == 0 and engine.sweep(-1)["documents"] == 1
    assert engine.table("chunks").where(F.col("document_id") == one).count() == 0
    bodies = engine.table("documents").select("document_id", F.lit(10).alias("bytes"))
    actions = {r.action for r in engine.rebuild_plan(bodies).collect()}
    assert actions <= {"keep", "derive"} and engine.rebuild_plan(bodies.limit(0)).where("action = 'refuse'").count() == engine.rebuild_plan(bodies).where("action = 'derive'").count()
