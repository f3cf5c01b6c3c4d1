"""Golden values of what SQL can't check: text functions, parsers, chunker, spans, statistics, ids."""

import hashlib
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import hashing, text
from folioforge.operators import analytics, chunking, corpus, embedding, evaluation, parsing, retrieval
from folioforge.sources import filesystem
from folioforge.streaming import watch

# --- text functions ---

STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_porter(word, stem):
    assert text.porter(word) == stem


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalar_functions(spark):
    assert one(spark, text.slugify(F.lit("  Hello, big World! "))) == "hello-big-world"
    assert one(spark, text.acronym_key(F.lit("s.l.a."))) == "SLA" and one(spark, text.acronym_key(F.lit("1x"))) is None
    assert one(spark, text.acronym_shaped(F.lit("SLAs"))) and not one(spark, text.acronym_shaped(F.lit("Hello")))
    assert one(spark, text.initials(F.lit("Department of the Interior"))) == "DI"
    assert [one(spark, text.brackets_balance(F.lit(t))) for t in ("a(b[c]{d})", "(]", "((", ")", "")] == [True, False, False, False, True]
    assert one(spark, text.origin_of(F.lit("HTTP://u@Example.ORG:80/x"))) == "http://example.org"
    assert one(spark, text.origin_of(F.lit("https://a:8443/"))) == "https://a:8443" and one(spark, text.origin_of(F.lit("x/y"))) is None
    assert one(spark, text.nfkc(F.lit("ﬁ①"))) == "fi1" and one(spark, text.unaccented(F.lit("éß"))) == "eß"
    assert one(spark, text.normal_key(F.lit("  Thank  YOU! "))) == "thank you"


def test_ids():
    parts = [b"document", b"w", b"s", b"i"]
    want = hashlib.blake2b(b"".join(len(p).to_bytes(8, "big") + p for p in parts), digest_size=16).hexdigest()
    assert hashing.digest("document", "w", "s", "i") == want
    assert hashing.digest("ab", "c") != hashing.digest("a", "bc")
    assert hashing.vector_checksum(np.array([0.0, 1.0])) == hashing.vector_checksum(np.array([-0.0, 1.0])) != hashing.vector_checksum(np.array([1.0, 0.0]))


# --- retrieval ---


def test_rrf_of_first_in_both_legs(spark):
    rows = [(1, leg, c, s) for leg in ("a", "b") for c, s in (("x", 9.0), ("y", 5.0))] + [(1, "a", "z", None)]
    got = {r.chunk_id: r for r in retrieval.rrf(spark.createDataFrame(rows, "query_id int, leg string, chunk_id string, score double")).collect()}
    assert got["x"].score == pytest.approx(2 / 61) and got["y"].score == pytest.approx(2 / 62) and got["z"].score == 0 and got["z"].rank == 3


def test_assembly_skips_and_does_not_stop(spark):
    rows = [(1, f"c{i}", i, t) for i, t in enumerate([5, 4, 3, 1], 1)]
    got = retrieval.assembled(spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, token_count int"), 8, 10).first()
    assert (got.passages, got.token_count, got.truncated, got.refused) == (["c1", "c3"], 8, True, False)


def test_confidence_counts_one_vote_per_document(spark):
    p = spark.createDataFrame([(1, 7, "a", 0.70, 2, None), (1, 7, "b", 0.70, 1, None), (1, 8, "c", 0.10, 1, None)], "query_id int, document_id int, chunk_id string, cosine double, n_legs int, logit double")
    got = retrieval.Confidence().scored(p).first()
    assert got.similarity == 1.0 and got.agreement == 0.5 and got.rerank is None and got.ceiling == pytest.approx(0.7) and got.score == pytest.approx(0.625) and got.band == "medium"


def test_dense_paths_agree(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(500, [0.0] * 8)], "chunk_id long, vector array<double>")
    q = v.where("chunk_id % 40 = 0").selectExpr("chunk_id as query_id", "vector")
    a, b = ({(r.query_id, r.chunk_id, r.rank) for r in f(v, q, 7).collect()} for f in (retrieval.dense_exact, retrieval.dense_batched))
    assert a == b and len(a) == 35


def test_unsupported_filters_are_refused(spark):
    with pytest.raises(corpus.UnsupportedFilter):
        corpus.Filter(sources=("x",)).predicate(corpus.VECTOR_FIELDS)
    assert spark.range(3).where(corpus.Filter(matches_nothing=True).predicate()).count() == 0
    assert spark.range(3).where(corpus.Filter().predicate()).count() == 3


def test_over_fetch(spark):
    cases = {(10, 1.0): 30, (10, 0.01): 200, (10, 0.2): 50, (1000, 0.05): 2000}
    for (k, live), want in cases.items():
        assert one(spark, retrieval.over_fetch(F.lit(k), F.lit(live))) == want
    assert [retrieval.ann_sub_vectors(d) for d in (1024, 64, 384, 17)] == [64, 4, 24, 1]


# --- parsing ---


def test_markdown():
    raw = b"---\ntitle: x\n---\n# One\n\ntext a\ntext b\n\n## Two\n- p\n- q\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n```\n# One\n<Card>hi</Card>\n"
    got = parsing.markdown(raw)
    assert [(b["kind"], b["heading_path"]) for b in got] == [("heading", ["One"]), ("prose", ["One"]), ("heading", ["One", "Two"]), ("list", ["One", "Two"]), ("table", ["One", "Two"]), ("code", ["One", "Two"]), ("heading", ["One"]), ("media", ["One"])]
    assert got[5]["text"] == "x = 1" and got[5]["lang"] == "py" and got[4]["text"] == "a | b\n1 | 2" and [b["anchor"] for b in got if b["kind"] == "heading"] == ["heading:one", "heading:two", "heading:one-1"]


def test_html():
    raw = b"<html><head><title>t</title><script>x</script></head><body><h1>A</h1><p>one <b>two</b></p><ul><li>x</li><li>y</li></ul><table><tr><th>h</th></tr><tr><td>v</td></tr></table><pre><code class='language-sql'>select\n1</code></pre><img alt='pic'><h2>B</h2>tail</body></html>"
    got = [(b["kind"], b["text"], b["heading_path"]) for b in parsing.html(raw)]
    assert got == [("heading", "A", ["A"]), ("prose", "one two", ["A"]), ("list", "- x\n- y", ["A"]), ("table", "h\nv", ["A"]), ("code", "select\n1", ["A"]), ("media", "pic", ["A"]), ("heading", "B", ["A", "B"]), ("prose", "tail", ["A", "B"])]


def test_other_parsers():
    assert [b["anchor"] for b in parsing.spreadsheet_csv(b"a,b\n1,2\n,\n")] == ["cell:!A1:B1", "cell:!A2:B2"]
    nb = {"metadata": {"language_info": {"name": "python"}}, "cells": [{"cell_type": "markdown", "id": "m", "source": ["# T\n", "p"]}, {"cell_type": "code", "id": "c", "source": "1/0", "outputs": [{"ename": "ZeroDivisionError", "evalue": "x", "traceback": []}]}]}
    assert [(b["kind"], b["heading_path"]) for b in parsing.notebook(json.dumps(nb).encode())] == [("heading", ["T"]), ("prose", ["T"]), ("code", ["T"]), ("code", ["T"])]
    got = parsing.mail(b"From: a@b.c\r\nSubject: s\r\nContent-Type: text/plain\r\n\r\nhello\r\n")
    assert [b["kind"] for b in got] == ["panel", "prose"] and "Subject: s" in got[0]["text"]
    assert [b["heading_path"] for b in parsing.source_python(b"import os\n\n# c\ndef f():\n    pass\n\nclass A:\n    x = 1\n")] == [[], ["f"], ["A"]]
    assert [b["heading_path"] for b in parsing.structured_json(b'{\n  "a": 1,\n  "b": {\n    "c": 2\n  }\n}')] == [[], ["a"], ["b"]]
    assert parsing.parse(b"\0\1\2", "text/plain")[1] == "unsupported_media_type"
    assert parsing.parse(b"%PDF", "application/pdf")[1] == "unsupported_media_type"
    assert parsing.parse(b"not zip", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")[1] == "failed"
    assert parsing.parse(b"  \n", "text/plain")[1] == "no_extractable_text"


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def test_office_and_archives():
    ns = 'xmlns:w="urn:w"'
    doc = f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>i</w:t></w:r></w:p><w:p><w:r><w:t>p</w:t></w:r></w:p></w:body></w:document>'
    assert [(b["kind"], b["heading_path"]) for b in parsing.word(_zip([("word/document.xml", doc)]))] == [("heading", ["H"]), ("list", ["H"]), ("prose", ["H"])]
    book = '<workbook><sheets><sheet name="S"/><sheet name="X" state="hidden"/></sheets></workbook>'
    sheet = '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1"><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>'
    assert [b["text"] for b in parsing.spreadsheet_xlsx(_zip([("xl/workbook.xml", book), ("xl/worksheets/sheet1.xml", sheet), ("xl/worksheets/sheet2.xml", sheet)]))] == ["k | 2", "k | "]
    inner = _zip([("d.txt", "deep")])
    got = parsing.members(_zip([("a.txt", "1"), ("../b", "2"), ("in.zip", inner)]))
    assert [(p, r) for p, _, r in got] == [("a.txt", ""), ("../b", "path"), ("in.zip!d.txt", "")]


# --- chunking ---


def test_sentences():
    assert chunking.sentences('See Dr. Smith. "Why?" he asked. A. B. Clark left.') == ["See Dr. Smith.", '"Why?" he asked.', "A. B. Clark left."]


def test_chunks_keep_text_and_budget():
    blocks = [{"kind": "heading", "text": "H", "heading_path": ["H"]}] + [{"kind": "prose", "text": f"Sentence number {i} is here. " * 12, "heading_path": ["H"]} for i in range(9)] + [{"kind": "table", "text": "h1 | h2\n" + "\n".join(f"{i} | {i}" for i in range(80)), "heading_path": ["H"], "header_rows": 1}]
    b = chunking.Budget(120, 16, 20, 20)
    got = chunking.chunk("Title", blocks, b)
    assert all(c["token_count"] <= 120 for c in got) and [c["position"] for c in got] == list(range(len(got)))
    assert all(c["text"].startswith("h1 | h2\n") for c in got if c["kind"] == "table") and sum(c["kind"] == "table" for c in got) > 2
    assert all(f"Sentence number {i} is here." in "".join(c["text"] for c in got) for i in range(9))
    assert chunking.breadcrumb(["A", "a", "B"], 10) == "A > B"
    assert "…" in chunking.breadcrumb(["Alpha one", *[f"Middle part {i}" for i in range(9)], "Omega"], 12)
    assert chunking.chunk("T", [{"kind": "heading", "text": "Only", "heading_path": []}])[0]["kind"] == "prose"


def test_longest_prefix_is_the_longest():
    t = "word " * 300
    cut = chunking.longest_prefix(t, 40)
    assert chunking.count_tokens(t[:cut]) <= 40 < chunking.count_tokens(t[: cut + 6])


# --- analytics ---


def test_glossary_forms():
    got = {(e["acronym"], e["expansion"], e["form"]) for e in analytics.detect("the Service Level Agreement (SLA) holds\n- RPO: Recovery Point Objective\nMTTR — Mean Time To Repair\nNOPE: something else entirely\nHTML (HyperText Markup Language)")}
    assert got == {("SLA", "Service Level Agreement", "parenthetical"), ("RPO", "Recovery Point Objective", "colon"), ("MTTR", "Mean Time To Repair", "dash"), ("HTML", "HyperText Markup Language", "term_first")}


def test_redaction():
    d = analytics.checked({"ticket": r"TICK-\d+"})
    got, n = analytics.redact("mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, TICK-42", d)
    assert got == "mail [email] or [ip-address], card [credit-card], [ticket]" and n == {"email": 1, "ip-address": 1, "credit-card": 1, "ticket": 1}
    for bad in ("(", "x*"):
        with pytest.raises(ValueError):
            analytics.checked({"bad": bad})


def test_marker_scanner_is_the_same_for_any_cut():
    t = "a [[cite:1,2]] b [[cite:x]] c [[cite:2]] [ [[ d [[cite:9"
    whole = analytics.MarkerScanner()
    want = whole.feed(t) + whole.close()
    for size in (1, 2, 3, 7):
        s = analytics.MarkerScanner()
        got = [e for i in range(0, len(t), size) for e in s.feed(t[i : i + size])] + s.close()
        assert "".join(str(v) for k, v in got if k == "text") == "".join(str(v) for k, v in want if k == "text")
        assert [e for e in got if e[0] != "text"] == [e for e in want if e[0] != "text"]
    assert [e for e in want if e[0] != "text"] == [("slots", [1, 2]), ("malformed", "[[cite:x]]"), ("slots", []), ("unterminated", "[[cite:9")]


# --- evaluation ---


def test_statistics(spark):
    assert evaluation.binomial_tail(0, 5, 0.3) == 1 and evaluation.binomial_tail(5, 5, 0.5) == pytest.approx(1 / 32)
    assert evaluation.sign_test(6, 0) == pytest.approx(2 / 64) and evaluation.sign_test(0, 0) == 1 and evaluation.smallest_detectable() == 6
    low, high = evaluation.wilson(F.lit(8), F.lit(10))
    assert one(spark, low) == pytest.approx(0.4902, abs=1e-3) and one(spark, high) == pytest.approx(0.9433, abs=1e-3)
    with pytest.raises(ValueError):
        evaluation.probe(None, None, 5, 5)


# --- embedding ---


def test_embedding():
    s, m = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert embedding.pooled(s, m, "cls").tolist() == [[0, 1, 2, 3]] and embedding.pooled(s, m, "mean").tolist() == [[2, 3, 4, 5]] and embedding.pooled(s, m, "last").tolist() == [[4, 5, 6, 7]]
    with pytest.raises(ValueError):
        embedding.pooled(s, m, "none")
    with pytest.raises(ValueError):
        embedding.canonical(np.array([np.nan]))
    assert [embedding.batch_size(w) for w in (128, 512, 20_000)] == [64, 32, 1]


def test_reuse_embeds_only_what_is_new(spark):
    chunks = spark.createDataFrame([("a", "i1", "t1"), ("b", "i2", "t2"), ("c", "i3", "t3"), ("d", "i3", "t3")], "chunk_id string, identity string, embed_text string")
    stored = spark.createDataFrame([("a", "i1", [1.0]), ("x", "i2", [2.0])], "chunk_id string, identity string, vector array<float>")
    got = {r.chunk_id: (r.origin, r.vector) for r in embedding.embed_or_reuse(chunks, stored, lambda t: np.full((len(t), 1), 9.0)).collect()}
    assert got == {"a": ("reused", [1.0]), "b": ("moved", [2.0]), "c": ("first_seen", [9.0]), "d": ("first_seen", [9.0])}


# --- sources and streams ---


def test_files(spark, tmp_path):
    for name, body in {"a.md": "# A", "sub/b.txt": "b", ".hidden": "x", "node_modules/c.js": "x", "a.md.meta.json": json.dumps({"id": "doc-1", "title": "T", "sha256": hashlib.sha256(b"# A").hexdigest()}), "sub/b.txt.meta.json": json.dumps({"id": "doc-2", "sha256": "00"})}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = filesystem.discover(spark, str(tmp_path))
    assert {(r.source_id, r.media_type) for r in found.collect()} == {("a.md", "text/markdown"), ("sub/b.txt", "text/plain")}
    content = filesystem.fetch(spark, str(tmp_path), found)
    assert {bytes(r.content) for r in content.collect()} == {b"# A", b"b"}
    said = {r.id: r.refused for r in filesystem.accepted_sidecars(filesystem.sidecars(spark, str(tmp_path)), content.select("path", "content")).collect()}
    assert said == {"doc-1": None, "doc-2": "checksum"}


def test_query_building():
    assert filesystem.content_query('A"B', ("page",), "2024-01-01 00:00", ("1", "2")) == 'space = "A\\"B" AND type in ("page") AND lastmodified >= "2024-01-01 00:00" AND (id in (1, 2) or ancestor in (1, 2))'
    with pytest.raises(ValueError):
        filesystem.content_query("A", ("page",), None, ("1 or 1=1",))


def test_file_stream(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    src.mkdir()
    write = watch.upsert_into(str(out), ["path"], "modificationTime")
    for step in ("one", "two"):
        (src / f"{step}.txt").write_text(step)
        watch.published(watch.watched(spark, str(src)).select("path", "modificationTime", "length"), write, str(mark)).awaitTermination()
    assert watch.upserted(spark, str(out), ["path"], "modificationTime").count() == 2


def test_settled_changes(spark):
    c = spark.createDataFrame([("a", 1, "changed"), ("a", 3, "deleted"), ("b", 2, "changed"), ("gone", 4, "changed"), ("x.tmp", 5, "changed")], "path string, seq int, change string")
    present = spark.createDataFrame([("b",), ("x.tmp",)], "path string")
    got = watch.settled(watch.coalesced(c), filesystem.ignored(F.col("path"), ("*.tmp",)), present).orderBy("place").collect()
    assert [(r.path, r.change) for r in got] == [("a", "deleted"), ("b", "changed")]


def test_snapshot_and_saved_pages(spark, tmp_path):
    from folioforge.sources import snapshots

    (tmp_path / "bodies").mkdir()
    (tmp_path / "bodies" / "a.html").write_text("A")
    (tmp_path / "bodies" / "b.html").write_text("B")
    lines = [{"id": "1", "title": "a", "file": "a.html", "sha256": hashlib.sha256(b"A").hexdigest(), "version": "1"}, {"id": "2", "title": "b", "file": "b.html", "sha256": "00", "version": "1"}, {"id": "3", "title": "c", "file": "c.html", "sha256": "00", "version": "1"}]
    (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert {r.id: r.outcome for r in snapshots.snapshot(spark, str(tmp_path)).collect()} == {"1": "taken", "2": "checksum", "3": "missing"}
    page = "<html><head><title>T</title></head><body><dl><dt>Author:</dt><dd>Jo</dd></dl><article><p>x &amp; y</p></article></body></html>"
    got = snapshots.adapted(spark.createDataFrame([(1, page), (2, "<p>no</p>"), (3, None)], "page_id int, html string"), (snapshots.Profile("site"),)).orderBy("id").collect()
    assert [(r.outcome, r.title, r.author, r.body) for r in got] == [("adapted", "T", "Jo", "<p>x &amp; y</p>"), ("no_profile", None, None, None), ("empty", None, None, None)]
