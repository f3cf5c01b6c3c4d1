"""Runs of repeating words against a search over all lags and places."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from folioforge.llm import periodic_runs
from folioforge.llm import queries as llm_queries

from . import data


def _all_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        start = None
        for i in range(len(words) - q + 1):
            if i < len(words) - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i + q - start >= max(24, 3 * q):
                    found.setdefault((start, i + q - start), q)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def _texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        letters = [f"v{i}" for i in range(rng.choice([1, 2, 3, 20, 400]))]
        words = [rng.choice(letters) for _ in range(rng.choice([0, 1, 23, 24, 60, 200, 500]))]
        for _ in range(rng.randrange(4)):
            cycle = [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (cycle * rng.randrange(2, 30))[: rng.randrange(1, 300)]
        out.append(words)
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    return [*out, list(fib[-1]), ["x"] * 24, ["x"] * 23, (["a"] * 30 + ["b"] * 30) * 4, (["a", "b"] * 12 + ["c"]) * 5, ["A", "a"] * 20]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_by_brute_force(seed):
    texts = _texts(seed)
    got = list(periodic_runs.found_in([" ".join(t) for t in texts]))
    n_found = 0
    for words, (n, runs, best, collapsed) in zip(texts, got, strict=True):
        want = _all_runs(words)
        n_found += len(want)
        assert n == len(words) and runs == want
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert best == (min(want, key=lambda r: (-r[1] / r[2], r[0], r[2])) if want else None)
    assert n_found > 50


def test_matches_of_light_and_heavy_words_are_exact():
    rng = np.random.default_rng(5)
    texts = [rng.zipf(1.3, n) % 300 for n in (1, 2, 40, 3000, 20_000)]
    numbers, fresh = [], 0
    for t in texts:
        numbers.append(np.unique(t, return_inverse=True)[1] + fresh)
        fresh = int(numbers[-1].max()) + 1
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    counts, base = periodic_runs.lag_matches(np.concatenate(numbers), at)
    for i, t in enumerate(texts):
        want = [int((t[q:] == t[:-q]).sum()) for q in range(1, len(t) // 3 + 1)]
        assert counts[base[i] : base[i + 1]].tolist() == want
    size = periodic_runs.fft_size(20_000)
    assert (np.bincount(numbers[-1]).astype(float) ** 2 > 0.5 * size * np.log2(size)).sum() > 0  # heavy words are among them


def test_long_texts_take_little_more_than_linear_time():
    rng = random.Random(2)
    for words in (["no"] * 400_000, ["a", "b"] * 200_000, [rng.choice("ab") for _ in range(100_000)], (["a"] * 500 + ["b"] * 500) * 200):
        began = time.process_time()
        n, runs, best, _ = next(periodic_runs.found_in([" ".join(words)]))
        assert n == len(words) and time.process_time() - began < 30
    assert best == (0, 500, 1) and (0, 200_000, 1000) in runs


def _repeated(doc_id, text):
    words = periodic_runs.WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_the_query(spark, tmp_path):
    rows = [(i, t, "r", "c") for i, t in enumerate([*data.texts(4, 200), "w " * 90, "é ß z " * 40])]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in llm_queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        words, r = _repeated(doc_id, text), got[doc_id]
        want = _all_runs(words) if len(words) < 3000 else None
        if want is not None:
            best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2])) if want else (None, None, None)
            gone = {i for s, length, q in want for i in range(s + q, s + length)}
            assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
            assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
            assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
            assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 3


def test_runs_of_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a " * 50, "x"), (1, None, "x"), (1, " \n", "x"), (1, " \n", "x")], "doc_id long, text string, n string")
    got = periodic_runs.found(docs).collect()
    assert sorted((str(r.doc_id), r.n, len(r.runs), r.collapsed) for r in got) == [("1", 0, 0, "")] * 3 + [("None", 50, 1, "a")]
    assert periodic_runs.found(data.empty(spark)).count() == 0
    assert llm_queries.with_repeats(docs).where("doc_id is null and text is null").count() == 0
