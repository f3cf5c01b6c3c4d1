"""SimHash: fingerprints, the trie's join and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from folioforge.llm import simhash_trie

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _print(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def _components(rows):
    """Component of each id: rows of one id hang together, and so do prints of two differing bits at most."""
    prints = [(i, _print(t)) for i, t in rows if i is not None]
    near = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 2]
    return _roots({i for i, _ in prints}, near)


@pytest.mark.parametrize("leaf", [4, 2048])
def test_simhash_by_brute_force(spark, leaf):
    rows = [(r[0], r[1]) for r in data.rows(5, 90)]
    long = data.words(random.Random(8), 900)
    rows += [(500 + i, long.rsplit(" ", i)[0]) for i in range(12)] + [(700, ""), (701, "\t\n"), (702, None), (None, long), (None, ""), (3, long.upper())]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, `print` string, root string").repartition(4)
    want = _components(rows)
    got = simhash_trie.components(docs, leaf=leaf).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{_print(t):016x}") for i, t in rows)
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(i != c for i, c in want.items()) > 10
    kept = simhash_trie.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i is None or want[i] == i)


def _prints(seed, groups, size):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("most,leaf", [(0, 8), (2, 6), (3, 40)])
def test_trie_finds_all_links(spark, most, leaf):
    """A dense group of 400 and forty small ones, through deep nodes of few fingerprints."""
    prints = np.unique(np.concatenate([_prints(most, 1, 400), _prints(most + 9, 40, 8)]))
    rows = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "`print` long").repartition(3)
    pairs = simhash_trie.small_pairs(rows, most, leaf)
    assert pairs.where("size(left) > {0} or size(right) > {0} or differ > {1}".format(leaf, most)).count() == 0
    found = [(r.a, r.b) for r in simhash_trie.links(pairs, most).collect()]
    signed = prints.view(np.int64).tolist()
    near = [(signed[i], signed[int(j)]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= most) + i + 1]
    assert _roots(signed, found) == _roots(signed, near) and (most == 0 or near)


def test_a_walk_finds_each_pair_once():
    a = _prints(3, 3, 60)
    left, right = a[::2].copy(), a[1::2].copy()
    for l, r, same in ((left, right, 0), (a, a, 1)):
        i, j = simhash_trie.walked(l, np.array([0, len(l)]), r, np.array([0, len(r)]), np.zeros(1, np.int64), np.array([same]), np.zeros(1, np.int64), 2)
        want = {(x, y) for x in range(len(l)) for y in range(len(r)) if int(l[x] ^ r[y]).bit_count() <= 2 and (not same or x < y)}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_simhash_of_nothing(spark):
    assert simhash_trie.components(data.empty(spark)).count() == 0
    assert simhash_trie.deduplicate(data.empty(spark)).count() == 0
