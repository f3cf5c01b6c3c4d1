"""MinHash near-dedup by chosen-path set similarity join.

A document's set is that of its words' shingles, hashed to 64 bits. Documents with equal
sets are one representative from the start. Representatives are cut by recursive trees: a
node, named by the path that leads to it, selects two of the signature's minwise positions,
and each document goes to the child of its token at either. Two documents of similarity s
part at a node with probability (1 - s)^2 and keep one child at least in common otherwise,
so with two children a node loses a pair of s = 0.75 in 11 % of all trees at any depth, and
``TREES`` independent trees lose it together with probability 0.111^TREES.

Nodes of up to ``NODE`` documents are compared exhaustively by signature. A larger node is
dealt out in blocks, each with the same ``REPS`` representatives of the node: documents that
hang together through representatives are one set already, and only the rest, those outside
the largest set, have to meet all blocks. If the rest is small it does, once; if it is larger
than a node, the node is cut into its children instead, and at ``DEPTH`` its rest meets all
blocks in blocks of its own. So a large group of near copies, which no token parts, costs its
size, and a node of unlike documents is cut further.

What nodes find is gathered into clusters, and the full sets alone decide inside these, by
the same rule: a cluster's texts meet in one task, those of one heavier than ``CLUSTER`` in
blocks with representatives, and a rest once more with all blocks. Links are those with an
intersection of ``num / den`` of the union at least. Only pairs not linked already through
others need their sets compared, so a group of copies costs about its size in comparisons.
Stars of links, never pairs, leave a task; components come from repeated star contraction
of tables in the shared folder.

Two documents of similarity 0.75 agree in fewer positions than ``LEAST_AGREE`` asks for once
in about ten million cases; that is the signature's own loss beside the trees'.

Cases: null or empty texts, and those of white space alone, have no set and are their own
component; with fewer words than a shingle has, all of them are one shingle; a very long text
has all its shingles and weighs as much in its block; of rows that repeat an id the least text
counts; a row without an id is linked with nothing and stays; ties of size or similarity are
settled by id; an empty table gives no rows; further columns are not read by ``components``
and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import flat_bytes, key_runs, slices, tidy, unused
from folioforge.plans.scratch import written

WORDS = 5
NUM, DEN = 75, 100
TREES = 5
POSITIONS = 128
#: Documents of a node that are compared exhaustively, and shingles of a cluster whose full sets meet in one task.
NODE, CLUSTER = 1024, 1 << 21
#: What a document weighs in a cluster besides its shingles.
DOC_WEIGHT = 500
#: Representatives of a group that is dealt out in blocks.
REPS = 32
#: Parts of a group of documents with one set.
SALTS = 32
DEPTH = 6
#: Signatures that agree in fewer positions are no candidates: 0.75 less five standard deviations.
LEAST_AGREE = 0.55
SEED = 20240229

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits in which every input bit counts for every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(1, 1 << 63, POSITIONS, np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the offsets of the texts in them."""
    n_docs = len(offsets) - 1
    low = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    inside = ~space
    begin = inside.copy()
    begin[1:] &= space[:-1]
    edges = offsets[:-1][offsets[:-1] < len(flat)]
    begin[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= space[1:]
    stops = offsets[1:][offsets[1:] > 0] - 1
    finish[stops] = inside[stops]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    up, down = _powers(len(low) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], dtype=np.uint64)))
    word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * M1)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    first = np.cumsum(counts) - counts
    made = np.maximum(counts - words + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n_docs), made)
    at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    size = np.minimum(counts, words)[owner]
    h = np.zeros(len(at), np.uint64)
    for j in range(words):
        live = size > j
        h[live] = mix(h[live] * M1 + word[at[live] + j] + np.uint64(j + 1))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n_docs)))).astype(np.int64)


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of each position's hash over each set that isn't empty: sets x POSITIONS."""
    live = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, POSITIONS), np.uint32)
    step = 1 << 16
    if not len(live):
        return out
    edges = offsets[:-1][live]
    # Stretches of whole sets that fit a processor's cache.
    i = 0
    while i < len(live):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + step)))
        a, b = edges[i], edges[j] if j < len(edges) else len(h)
        part, local = h[a:b], edges[i:j] - a
        for k in range(POSITIONS):
            out[live[i:j], k] = np.minimum.reduceat(((part * FACTORS[k]) >> np.uint64(32)).astype(np.uint32), local)
        i = j
    return out


def _set_keys(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    import hashlib

    raw = memoryview(h.astype("<u8").tobytes())
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def sketched(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                h, offsets = shingle_sets(*flat_bytes(batch.column(1)), words)
                raw = signatures(h, offsets).astype("<u4").tobytes()
                width = 4 * POSITIONS
                yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(_set_keys(h, offsets), pa.binary()), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])
        _POWERS.clear()
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _children(nodes: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The two child nodes of each document at its node: documents x 2."""
    out = np.empty((len(nodes), 2), np.uint64)
    draw = mix(nodes * M1 + np.uint64(1))
    first = draw % np.uint64(POSITIONS)
    second = (first + np.uint64(1) + (draw >> np.uint64(32)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
    for j, position in enumerate((first, second)):
        token = signs[np.arange(len(nodes)), position.astype(np.int64)].astype(np.uint64)
        out[:, j] = mix(mix(nodes ^ (position + np.uint64(1)) * M2) + token * M1)
    return out


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, POSITIONS)


def descended(rows: DataFrame, roots: int = 0) -> DataFrame:
    """``node, id`` of the children of each ``node, id, signature``; with ``roots``, of so many root nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs, ids = _signs(batch.column("signature")), np.asarray(batch.column("id"), np.int64)
            starts = [mix(np.full(len(ids), SEED + r, np.uint64)) for r in range(roots)] if roots else [np.asarray(batch.column("node"), np.int64).view(np.uint64)]
            made = np.concatenate([_children(s, signs).reshape(-1) for s in starts])
            yield pa.record_batch([pa.array(made.view(np.int64)), pa.array(np.concatenate([np.repeat(ids, 2)] * len(starts)))], ["node", "id"])

    return rows.mapInArrow(run, "node long, id long")


def spread(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Roots of n members, joined where ``alike(i, others)`` says so; a set's root is its least member.

    Each member is compared only with those that no set has reached yet, so members of one set
    are not compared with each other again: a group of copies costs about one look at each.
    """
    roots = np.arange(n)
    left = np.arange(n)
    while len(left):
        seed, left = int(left[0]), left[1:]
        queue = [seed]
        while queue and len(left):
            i = queue.pop()
            hit = alike(i, left)
            if hit.any():
                new = left[hit]
                roots[new] = seed
                queue += new.tolist()
                left = left[~hit]
    return roots


def signs_alike(signs: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of others agree with a member in enough positions."""
    need = int(np.ceil(LEAST_AGREE * POSITIONS))
    return lambda i, others: (signs[others] == signs[i]).sum(1) >= need


#: Members of a group in order of their ids, and the roots of those that belong together.
Find = Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _members(group: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids in order, once each, the rows they are first met in, and the bodies of these rows."""
    ids, rows = np.unique(np.asarray(group.column("id").combine_chunks(), np.int64), return_index=True)
    bodies = group.column("body").combine_chunks()
    bodies = bodies if isinstance(bodies, pa.Array) else bodies.chunk(0)
    return ids, rows, bodies.take(pa.array(rows))


def by_signature(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows, bodies = _members(group)
    return ids, rows, spread(len(ids), signs_alike(_signs(bodies)))


def by_sets(words: int, num: int, den: int) -> Find:
    def find(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, rows, bodies = _members(group)
        sets: list[np.ndarray] = []
        for batch in slices(pa.record_batch([bodies], ["text"]), "text", 1 << 20):
            h, offsets = shingle_sets(*flat_bytes(batch.column(0)), words)
            sets += [h[a:b].copy() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return ids, rows, linked(sets, num, den)

    return find


def _met(rows: DataFrame) -> DataFrame:
    """Rows of one ``place`` next to each other, in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "place").sortWithinPartitions("place")


def stars(rows: DataFrame, find: Find) -> DataFrame:
    """Links ``a, b`` of each member to its set's least member, from ``place, id, body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, "place"):
            if group.num_rows < 2:
                continue
            ids, _, roots = find(group)
            away = np.flatnonzero(roots != np.arange(len(ids)))
            if len(away):
                yield pa.record_batch([pa.array(ids[away]), pa.array(ids[roots[away]])], ["a", "b"])
        _POWERS.clear()
        tidy()

    return _met(rows).mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame, sizes: DataFrame, most: int, find: Find) -> tuple[DataFrame, DataFrame]:
    """Large groups, dealt out in blocks of about ``most`` that share representatives.

    ``rows`` has ``key, id, weight, body``, ``sizes`` has ``key, n, blocks``. Returns the links found, and
    the rest of each group: ``key, id, weight`` of members outside its largest set.
    """
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks"))
    placed = rows.join(sizes, "key").withColumn("block", own)
    # About four times as many as are wanted, by a hash limit; only those are ranked.
    draw = F.pmod(F.xxhash64("id", "key", F.lit(SEED + 1)), F.lit(1 << 30))
    few = placed.withColumn("draw", draw).where(F.col("draw").cast("double") * F.col("n") < float(4 * REPS << 30))
    order = Window.partitionBy("key").orderBy("draw", "id")
    reps = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= REPS)
    reps = reps.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["key", "id", "weight", "body", "block"]
    met = reps.select(*columns, F.lit(True).alias("rep")).unionByName(placed.select(*columns, F.lit(False).alias("rep")))
    met = met.withColumn("place", F.xxhash64("key", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, "place"):
            ids, at, roots = find(group)
            rep_ids = np.asarray(group.column("id").combine_chunks().filter(group.column("rep").combine_chunks()), np.int64)
            rep = np.isin(ids, rep_ids)
            # A set is named by its least representative, if it has one.
            label = np.full(len(ids), -1)
            label[roots[rep][::-1]] = np.flatnonzero(rep)[::-1]
            named = label[roots]
            mine = [group.column(c).combine_chunks().take(pa.array(at)) for c in ("place", "key", "weight")]
            yield pa.record_batch([*mine, pa.array(ids), pa.array(ids[roots]), pa.array(ids[named], mask=named < 0), pa.array(rep)], ["place", "key", "weight", "id", "root", "label", "rep"])
        _POWERS.clear()
        tidy()

    out = written(_met(met).mapInArrow(run, "place long, key long, weight long, id long, root long, label long, rep boolean"), "blocks")
    # Sets that share a representative anywhere are one: each goes by the least name its own one has in any block.
    # There are REPS names in a block at most, so these tables are small beside the members, who meet them by block.
    at_place = ["key", "place", "label"]
    up = out.where("rep").groupBy("key", F.col("id").alias("label")).agg(F.min("label").alias("set"))
    names = written(out.where("rep").select("key", "place", F.col("id").alias("label")).join(up, ["key", "label"]), "names")
    counts = out.where("label is not null and not rep").groupBy(*at_place).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.join(names, at_place).groupBy("key", "set").agg(F.sum("n").alias("n"))
    main = sums.groupBy("key").agg(F.max_by("set", F.struct("n", "set")).alias("set"))
    inside = names.join(main, ["key", "set"], "left_semi").select(*at_place)
    rest = out.join(inside, at_place, "left_anti").select("key", "id", "weight")
    return out.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), written(rest.distinct(), "rest")


def with_rest(rows: DataFrame, sizes: DataFrame, rest: DataFrame, rest_sizes: DataFrame) -> DataFrame:
    """``place, id, body`` in which each group's rest meets all its members: each block of one with each block
    of the other. ``rest_sizes`` has ``key, rest_blocks``; where that is one, each member is sent once.
    """
    hashed = F.xxhash64("id", F.lit(SEED))
    all_ = rows.join(sizes.select("key", "blocks"), "key").join(rest_sizes, "key")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    members = all_.withColumn("block", F.pmod(hashed, "blocks")).withColumn("other", each("rest_blocks"))
    others = all_.join(rest.select("key", "id"), ["key", "id"], "left_semi").withColumn("other", F.pmod(hashed, "rest_blocks")).withColumn("block", each("blocks"))
    place = F.xxhash64("key", "block", "other").alias("place")
    return members.select(place, "id", "body").unionByName(others.select(place, "id", "body"))


def blocks_of(rest: DataFrame, most: int) -> DataFrame:
    return rest.groupBy("key").agg(F.sum("weight").alias("w")).select("key", F.ceil(F.col("w") / most).cast("long").alias("rest_blocks"))


def candidates(signs: DataFrame, trees: int, node: int, depth: int) -> DataFrame:
    """Stars of documents that nodes find alike, from ``id, signature``."""
    rows = descended(signs, trees)
    found: list[DataFrame] = []
    meet: list[DataFrame] = []  # what is compared exhaustively, of all levels together
    body = F.col("signature").alias("body")
    for level in range(1, depth + 1):
        # Another tree may lead a document to a node twice, as long as names differ by path it doesn't.
        rows = written(rows.distinct() if level > 1 else rows, "nodes")
        counts = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "node-sizes")
        small = rows.join(counts.where(F.col("n") <= node).select("node"), "node", "left_semi").join(signs, "id")
        meet.append(small.select(F.col("node").alias("place"), "id", body))
        sizes = counts.where(F.col("n") > node).select(F.col("node").alias("key"), "n", F.ceil(F.col("n") / node).cast("long").alias("blocks"))
        if sizes.isEmpty():
            break
        crowded = rows.join(sizes.select(F.col("key").alias("node")), "node", "left_semi").join(signs, "id")
        crowded = written(crowded.select(F.col("node").alias("key"), "id", F.lit(1).cast("long").alias("weight"), body), "crowded")
        links, rest = in_blocks(crowded, sizes, node, by_signature)
        found.append(links)
        left = written(blocks_of(rest, node), "rest-sizes")
        meet.append(with_rest(crowded, sizes, rest, left if level == depth else left.where("rest_blocks = 1")))
        unlike = left.where("rest_blocks > 1").select("key")
        if level == depth or unlike.isEmpty():
            break
        rows = descended(crowded.join(unlike, "key", "left_semi").select(F.col("key").alias("node"), "id", F.col("body").alias("signature")))
    out = stars(reduce(DataFrame.unionByName, meet), by_signature)
    return reduce(DataFrame.unionByName, found, out).distinct()


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, root``: the least id reachable, for every id in ``links`` (``a, b``), itself included.

    Alternates a contraction onto each id's least neighbour over larger and over smaller
    neighbours until nothing changes. Sums and joins are by id, so no star's members meet in
    one task but those a join may split.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.min("b").alias("m"))

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = least(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(to, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        to = least(large)
        joined = large.join(to, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(to.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "small-star")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Roots of the documents, joined where the full sets are similar enough.

    A member's shingles are marked once, and those of all others that can be as similar by
    their sizes are looked up together.
    """
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(sizes)))
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(words), np.uint8)

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        hit = den * small >= num * large
        k = np.flatnonzero(hit)
        if not len(k):
            return hit
        mine = flat[at[i] : at[i + 1]]
        marked[mine] = 1
        asked = others[k]
        long = sizes[asked]
        starts = np.cumsum(long) - long
        same = np.add.reduceat(marked[flat[np.repeat(at[asked] - starts, long) + np.arange(int(long.sum()))]], starts, dtype=np.int64)
        marked[mine] = 0
        hit[k] = den * same >= num * (long + sizes[i] - same)
        return hit

    return spread(len(sets), alike)


def verified(docs: DataFrame, clusters: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, most: int) -> DataFrame:
    """Stars of true links inside clusters of ``id, root, n_shingles``."""
    find = by_sets(words, num, den)
    weighed = clusters.select(F.col("root").alias("key"), "id", (F.col("n_shingles") + DOC_WEIGHT).alias("weight"))
    sizes = written(weighed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).where("n > 1"), "cluster-sizes")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    small = weighed.join(sizes.where(F.col("w") <= most).select("key"), "key", "left_semi")
    found = stars(texts.join(small, "id").select(F.col("key").alias("place"), "id", "body"), find)
    large = sizes.where(F.col("w") > most).select("key", "n", F.ceil(F.col("w") / most).cast("long").alias("blocks"))
    if large.isEmpty():
        return found
    rows = texts.join(weighed.join(large.select("key"), "key", "left_semi"), "id").select("key", "id", "weight", "body")
    links, rest = in_blocks(rows, large, most, find)
    found = found.unionByName(links)
    left = written(blocks_of(rest, most), "rest-sizes")
    return found if left.isEmpty() else found.unionByName(stars(with_rest(rows, large, rest, left), find))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, trees: int = TREES, node: int = NODE, cluster: int = CLUSTER, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    rows = written(sketched(docs, id_col, text_col, words), "sketches")
    made = rows
    repeated = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        # One text for each id: the least one. All rows of the id show its result.
        named = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
        again = named.join(repeated.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
        least = again.groupBy(id_col).agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias(text_col))
        docs = written(named.join(repeated.select(F.col("doc_id").alias(id_col)), id_col, "left_anti").unionByName(least), "once")
        made = written(sketched(docs, id_col, text_col, words), "sketches")
    once = made.where("n_shingles > 0 and doc_id is not null")
    # A set that many documents share is dealt over SALTS tasks; only its sums meet by its key.
    keyed = once.select("doc_id", "set_key", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(SALTS)).alias("salt"))
    parts = keyed.groupBy("set_key", "salt").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    copies = parts.groupBy("set_key").agg(F.min("id").alias("__rep"), F.sum("n").alias("n")).where("n > 1").drop("n")
    named = parts.select("set_key", "salt").join(copies, "set_key")
    stands = written(keyed.join(named, ["set_key", "salt"]).select("doc_id", "__rep").distinct(), "copies")
    others = stands.where("doc_id <> __rep").select("doc_id")
    signs = written(once.select(F.col("doc_id").alias("id"), "signature").join(others.withColumnRenamed("doc_id", "id"), "id", "left_anti").dropDuplicates(["id"]), "signatures")
    clusters = written(connected(candidates(signs, trees, node, depth)), "clusters")
    weighed = clusters.join(once.select(F.col("doc_id").alias("id"), "n_shingles"), "id")
    links = verified(docs, weighed, id_col, text_col, words, num, den, cluster)
    roots = written(connected(written(links, "links")), "roots")
    final = stands.join(roots, F.col("__rep") == F.col("id"), "left").select(F.col("doc_id").alias("id"), F.coalesce("root", "__rep").alias("root"))
    final = final.unionByName(roots.join(stands.select(F.col("doc_id").alias("id")), "id", "left_anti"))
    own = made.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("id"), "left").drop("id")
    if made is not rows:
        known = rows.select(F.col("doc_id").alias("id")).join(own, F.col("id") == F.col("doc_id")).drop("id")
        own = known.unionByName(own.where("doc_id is null"))
    component = F.coalesce("root", "doc_id")
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents kept, one of each component, with their own columns."""
    name = unused(docs, "gone")
    gone = components(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
