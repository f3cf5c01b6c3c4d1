"""The pipeline's stages, each followed by brute force from what the one before it wrote."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from folioforge.llm import apportion_mix
from folioforge.llm import queries as llm
from folioforge.plans.scratch import written

from ..oracle import connection, difference
from . import data
from .test_operators import LOWER, PATH, _components, _fused, _sets, _targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, *r[1:]) for i, r in enumerate(data.rows(3, 90))]
    spark.createDataFrame(rows, data.SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out], [d.columns for d in out], sf


def test_stage_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
    _, columns, _ = stages
    assert all(c == columns[0] for c in columns[:-1])


def test_language_stage(spark, stages):
    """The rows that a brute-force fusion accepts, with the model fitted on rows that aren't held out."""
    (before, after, *_), _, sf = stages
    model = llm.language_model(spark.read.parquet(f"{sf}/documents.parquet"))
    judged = _fused([(r["text"], r["lang"], None, r["source"]) for r in before], model)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, (_, _, good) in zip(before, judged, strict=True) if good)


def test_exact_stage(stages):
    (_, before, after, *_), _, _ = stages
    by = defaultdict(list)
    for r in before:
        by[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    assert {r["doc_id"] for r in after} == {max(v) for v in by.values()}


def test_near_stage(stages):
    (_, _, before, after, *_), _, _ = stages
    want = _components(_sets([(r["doc_id"], r["text"]) for r in before]))
    assert sorted(r["doc_id"] for r in after) == sorted({*want.values()})


def test_mix_stage(stages):
    (_, _, _, before, after, _), _, _ = stages
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    for s, t in _targets(sizes).items():
        assert abs(taken[s] - t) <= 4 * apportion_mix.BLOCK_WORDS
    text_of = {r["doc_id"]: r["text"] for r in before}
    assert all(text_of[r["doc_id"]].startswith(r["text"]) for r in after)


def test_pack_stage(stages):
    (*_, before, after), _, _ = stages
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for r in before:
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want[r["doc_id"]] += len(ids)
    got = Counter()
    for r in after:
        got[r["doc_id"]] += r["length"]
    assert got == want and max(r["offset"] + r["length"] for r in after) <= 1024


def test_run_is_the_stages_in_order(spark, stages):
    got, _, sf = stages
    key = lambda r: tuple(v for k, v in sorted(r.items()) if k not in ("sequence_id", "offset"))
    run = [r.asDict() for r in entry.queries()["pipeline"](spark, sf).collect()]
    assert sorted(map(key, run)) == sorted(map(key, got[-1]))


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    """Rows of one id, and those of none, stay or go together: with c or e among them those of none stay. What stays is packed."""
    rng = random.Random(2)
    a, b, c, d, e = (data.words(rng, 120) for _ in range(5))
    near = " ".join([*d.split(" ")[:-2], "other", "end"])
    rows = [(None, a), (5, a), (5, b), (20, near), (None, c), (None, c), (9, d), (9, d), (None, e), (12, None), (13, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert len(kept["language"]) == len(rows)
    assert {t for _, t in kept["exact_dedup"]} == {a, b, c, d, e, near, ""}
    assert [i for i, t in kept["exact_dedup"] if t == a] == ["5", "None"] and {i for i, t in kept["exact_dedup"] if t in (c, e)} == {"None"}
    assert [i for i, t in kept["exact_dedup"] if t == ""] == ["13"]
    assert {t for _, t in kept["near_dedup"]} >= {b, c, d, e} and near not in {t for _, t in kept["near_dedup"]}
    for name, stage in corpus_pipeline.STAGES[3:]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
    packed = docs.collect()
    assert {str(r.doc_id) for r in packed} <= {i for i, _ in kept["near_dedup"]} and "None" in {str(r.doc_id) for r in packed}


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", llm.QUERIES)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) >= 200 or "pages" in name or name.startswith("op3")
    if name in llm.SQL:
        assert difference(got, connection(SF).sql(llm.SQL[name]).df()) == ""


def test_checksums_of_pieces(spark):
    t = Tokenizer.from_file(PATH)
    text_of = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["op6_pack_sequences"](spark, SF).collect():
        ids = np.array(t.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
