"""Chunks by expressions against the chunker that works in Python."""

import random

import pytest

from folioforge.operators import chunk_plan, chunking

SCHEMA = "document_id string, position int, kind string, path array<string>, text string, header_rows int"


def _documents(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma-ray", "x", "3.5", "it's", "Dr.", "naïve"])
    sentence = lambda n: " ".join(word() for _ in range(n)).strip() + rng.choice([".", "!", "?", '."'])
    out = {}
    for d in range(30):
        blocks, path = [], []
        for _ in range(rng.randrange(0, 14)):
            kind = rng.choice(["heading", "prose", "prose", "prose", "list", "code", "table"])
            if kind == "heading":
                path = [f"h{rng.randrange(5)}"]
                text = path[0]
            elif kind in ("code", "table"):
                text = "\n".join(" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9)))
            else:
                text = rng.choice(["\n\n", " ", "\n \n"]).join(sentence(rng.choice([1, 3, 8, 30])) for _ in range(rng.randrange(0, 6)))
            blocks.append({"kind": kind, "text": rng.choice(["", text, text, text, text]), "heading_path": list(path), "header_rows": 1 if kind == "table" and text.count("\n") else 0})
        out[f"d{d:02}"] = blocks
    out["only"] = [{"kind": "heading", "text": t, "heading_path": [t], "header_rows": 0} for t in ("One", "Two")]
    return out


@pytest.mark.parametrize("budget", [chunking.Budget(40, 10, 8, 10), chunking.Budget(24, 0, 6, 4), chunking.Budget(500, 64, 64, 64)])
def test_chunks_are_those_of_the_chunker(spark, budget):
    docs = _documents(budget.most)
    rows = [(d, i, b["kind"], b["heading_path"], b["text"], b["header_rows"]) for d, bs in docs.items() for i, b in enumerate(bs)]
    got = {}
    for r in chunk_plan.chunks(spark.createDataFrame(rows, SCHEMA).repartition(3), budget).collect():
        got.setdefault(r.document_id, []).append((r.position, r.text, r.kind, r.path))
    want = {d: made for d, bs in docs.items() if (made := [(c["position"], c["text"], c["kind"], c["heading_path"]) for c in chunking.chunk("", bs, budget)])}
    assert {d: sorted(v) for d, v in got.items()} == want
    assert sum(map(len, want.values())) > 30


def test_a_chunk_leaves_its_document_with_its_own_text_alone(spark):
    """A long document's rows would be as many as its chunks, each with all its texts, if its array stayed beside them."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta", "x", "3.5"]) for _ in range(rng.randrange(1, 12))) + "." for _ in range(4_000)]
    texts[1_000] = " ".join(["word"] * 2_000)
    rows = [("d", i, "prose", ["h"], t, 0) for i, t in enumerate(texts)]
    budget = chunking.Budget(50, 10, 12, 10)
    made = chunk_plan.chunks(spark.createDataFrame(rows, SCHEMA), budget)
    node = made._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Generate":
        node = node.children().head()
    kinds = [node.output().apply(i).dataType().catalogString() for i in range(node.output().length())]
    assert len(kinds) == 3 and not any(k.startswith("array") for k in kinds)
    got = sorted((r.position, r.text, r.token_count) for r in made.collect())
    blocks = [{"kind": "prose", "text": t, "heading_path": ["h"], "header_rows": 0} for t in texts]
    assert got == [(c["position"], c["text"], chunking.count_tokens(c["text"])) for c in chunking.chunk("", blocks, budget)]


def test_blocks_that_are_counted_before_are_not_counted_again(spark):
    rows = spark.createDataFrame([("d", 0, "prose", [], "One two. Three four.", 0)], SCHEMA)
    whole = chunk_plan.chunks(rows.selectExpr("*", "6 AS tokens"), chunking.Budget(20, 0, 2, 10)).collect()
    assert [(r.text, r.token_count) for r in whole] == [("One two. Three four.", 6)]
    told = chunk_plan.chunks(rows.selectExpr("*", "7 AS tokens"), chunking.Budget(20, 0, 2, 10)).collect()
    assert [r.token_count for r in told] == [7]
