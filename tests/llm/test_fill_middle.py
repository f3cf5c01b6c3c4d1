"""Fill-in-the-middle forms against a plain version, and back again."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from folioforge.llm import fill_middle
from folioforge.llm import queries as llm_queries

from . import data

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def _plain(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_by_brute_force(spark):
    rng = random.Random(3)
    odd = ["<", ">", "P", "S", "M", "<P", "S>", "é", "日", "😀", "a", "ab", " ", "\n", "\r\n", "\x00", "é"]
    texts = [r[1] for r in data.rows(2, 80)] + ["".join(rng.choice(odd) for _ in range(rng.randrange(30))) for _ in range(300)] + ["x<P>y", "x" * 300_000, "ab " * 90_000, "é" * 100_000]
    rows = [(i, t, "o", "f") for i, t in enumerate(texts)] + [(None, "a text without id", "o", "f"), (5, texts[5], "o", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, form string").repartition(3)
    made = fill_middle.transformed(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = {}
    for r in made.collect():
        got.setdefault(r.doc_id, []).append((r.n, r.form, r.prefix_chars, r.middle_chars, r.output))
        assert r.back == (texts[r.doc_id] or "" if r.doc_id is not None else "a text without id")
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, *_ in rows:
        assert got[doc_id] == [_plain(doc_id, text)] * len(got[doc_id])
    assert {x[0][1] for x in got.values()} == {"plain", "psm", "spm"}


def test_units_are_the_same_in_any_blocks():
    splitter = fill_middle.unit_splitter()
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "D", " ", "é", "1", "\n"]) for _ in range(rng.randrange(40)))
        want = [m.start() for m in UNIT.finditer(text)]
        for size in (1, 2, 3, 7, 100):
            assert fill_middle.unit_offsets(text, splitter, size).tolist() == want
            assert "".join(part for _, part in fill_middle.blocks(text, size)) == text


def test_digests_of_the_query(spark, tmp_path):
    data.docs(spark).select("doc_id", "text").where("doc_id < 60").write.parquet(f"{tmp_path}/documents.parquet")
    for r in llm_queries.op12_fill_middle(spark, str(tmp_path)).collect():
        text = data.rows()[r.doc_id][1]
        n, form, prefix, middle, output = _plain(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_forms_of_nothing(spark):
    assert fill_middle.transformed(data.empty(spark)).count() == 0
