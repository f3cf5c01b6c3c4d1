"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 hashes, each as
often as it occurs, have it set. Fingerprints link at ``MOST`` differing bits or fewer.

The join walks pairs of trie nodes of one depth, from the root with itself: a pair's children
carry the bits in which their paths differ, and a pair over the budget goes no further. Its
upper part is tables in Spark: nodes are counted by the first bits of distinct fingerprints,
and a pair that holds more than ``LEAF`` of them is replaced by its children's pairs, found by
an equi-join on the path that each allowed flip of bits leads to. Only what hangs below such
pairs is counted again. The lower part runs in the tasks: each pair of small nodes is one row
with both nodes' sorted fingerprints, and all pairs of a batch are walked bit by bit together.
A node of ``n`` fingerprints has at most n times 1 + 64 + 64 * 63 / 2 links, however dense a
group is; what leaves a task is a spanning forest of its links, so a group costs about its size
there. Copies of one fingerprint are one node from the start, by sums that are dealt over
``SALTS`` parts first. Components come from repeated star contraction of written tables.

Cases: texts that are null, empty or of white space have fingerprint zero, which links like any
other; with fewer words than a shingle has, all of them are one; very long texts have all their
shingles; rows that repeat an id each show their own fingerprint, and link what these link;
a row without an id has a fingerprint, is linked with nothing and stays; ties are settled by
id; an empty table gives no rows; further columns are not read by ``components`` and kept by
``deduplicate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.chosen_path import connected
from folioforge.llm.common import UPPER, slices, tidy, unused, utf8_of
from folioforge.plans.scratch import written

WORDS, SEED = 3, 42
MOST = 2
BITS = 64
#: Fingerprints of a pair of nodes that is walked in one task.
LEAF = 2048
#: Bits from the root to the first nodes that are counted, and from there to the next ones.
FIRST, STEP = 8, 2
SALTS = 32
#: Pairs of nodes that a task walks at a time, fingerprints that it takes at a time, and comparisons that end a walk.
WALKED, TAKEN, DIRECT = 1 << 19, 1 << 16, 16

BYTE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """The XXH64 of every shingle of a text in UTF-8, in order, repeats included."""
    from xxhash import xxh64_intdigest

    found = BYTE_WORD.findall(text.translate(LOWER))
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), SEED)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each stretch of hashes, the bits that are set in more than half of them; none in an empty one."""
    out = np.zeros(len(at) - 1, np.uint64)
    sizes = np.diff(at)
    live = np.flatnonzero(sizes)
    if len(live):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        often = np.stack([bits[a:b].sum(0, dtype=np.int64) for a, b in zip(at[live].tolist(), at[live + 1].tolist(), strict=True)])
        out[live] = np.packbits(2 * often > sizes[live, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, print`` of each row, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                parts = [np.array(shingle_hashes(t, words), np.uint64) for t in utf8_of(batch.column(1))]
                at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
                yield pa.record_batch([batch.column(0), pa.array(majority(np.concatenate(parts), at).view(np.int64))], ["doc_id", "print"])
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, print long")


def node_of(print_: Column, depth: int) -> Column:
    """The first bits of a fingerprint, as the path to a node."""
    return F.shiftrightunsigned(print_, BITS - depth)


def children_pairs(pairs: DataFrame, nodes: DataFrame, step: int, most: int) -> DataFrame:
    """``a, b, differ, n_a, n_b``: pairs of nodes below each pair ``a, b, differ`` that stay in the budget.

    ``nodes`` has ``node, n`` of a depth that is ``step`` bits below. The nodes below a meet those of
    b by the path that each flip of up to ``most`` bits leads to. Of a node with itself each pair of
    children comes once.
    """
    flips = [m for m in range(1 << step) if m.bit_count() <= most]
    below = nodes.select(F.shiftrightunsigned("node", step).alias("a"), F.col("node").alias("child"), F.col("n").alias("n_a"))
    grown = pairs.join(below, "a").withColumn("flip", F.explode(F.array(*[F.lit(m).cast("long") for m in flips])))
    other = F.shiftleft("b", step).bitwiseOR(F.col("child").bitwiseAND((1 << step) - 1).bitwiseXOR(F.col("flip")))
    grown = grown.select("child", other.alias("node"), (F.col("differ") + F.bit_count("flip")).alias("differ"), "n_a", (F.col("a") == F.col("b")).alias("same"))
    grown = grown.where((F.col("differ") <= most) & (~F.col("same") | (F.col("child") <= F.col("node"))))
    return grown.join(nodes.select("node", F.col("n").alias("n_b")), "node").select(F.col("child").alias("a"), F.col("node").alias("b"), "differ", "n_a", "n_b")


def small_pairs(prints: DataFrame, most: int, leaf: int) -> DataFrame:
    """``depth, differ, same, left, right``: pairs of nodes with up to ``leaf`` fingerprints, as their sorted lists.

    All pairs of distinct fingerprints, from the column ``print``, within the budget are inside one of them.
    """
    spark = prints.sparkSession
    pairs = spark.createDataFrame([(0, 0, 0)], "a long, b long, differ int")
    found: list[DataFrame] = []
    depth, step = FIRST, FIRST
    while True:
        node = node_of(F.col("print"), depth).alias("node")
        nodes = written(prints.groupBy(node).agg(F.count(F.lit(1)).alias("n")), "trie-nodes")
        pairs = written(children_pairs(pairs, nodes, step, most), "trie-pairs")
        together = F.when(F.col("a") == F.col("b"), F.col("n_a")).otherwise(F.col("n_a") + F.col("n_b"))
        end = depth >= BITS
        small = pairs if end else pairs.where(together <= leaf)
        used = small.select(F.col("a").alias("node")).unionByName(small.select(F.col("b").alias("node"))).distinct()
        # A node of a small pair has up to ``leaf`` fingerprints, so its list is bounded.
        lists = prints.select(node, "print").join(used, "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("print")).alias("prints"))
        lists = written(lists, "trie-lists")
        met = small.join(lists.select(F.col("node").alias("a"), F.col("prints").alias("left")), "a").join(lists.select(F.col("node").alias("b"), F.col("prints").alias("right")), "b")
        found.append(met.select(F.lit(depth).alias("depth"), "differ", (F.col("a") == F.col("b")).alias("same"), "left", "right"))
        crowded = pairs.where(together > leaf)
        if end or crowded.isEmpty():
            return reduce(DataFrame.unionByName, found)
        busy = crowded.select(F.col("a").alias("node")).unionByName(crowded.select(F.col("b").alias("node"))).distinct()
        prints = written(prints.withColumn("node", node).join(busy, "node", "left_semi").select("print"), "trie-prints")
        pairs = crowded.select("a", "b", "differ")
        step = min(STEP, BITS - depth)
        depth += step


def walked(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray, differ: np.ndarray, same: np.ndarray, depth: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints of ``left`` and ``right`` that link, of all pairs of nodes together.

    The nodes' fingerprints lie sorted one after the other, at the given offsets; a node of the
    trie below is a range of them. ``differ`` has the bits spent above ``depth``.
    """
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    ones: dict[tuple[int, int], np.ndarray] = {}

    def set_before(side: int, bit: int) -> np.ndarray:
        """How many fingerprints before each place have a bit of the path set."""
        if (side, bit) not in ones:
            values = (left, right)[side]
            ones[side, bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(BITS - 1 - bit)) & np.uint64(1), dtype=np.int64)))
        return ones[side, bit]

    stack = [(int(d), np.stack([left_at[:-1][k], left_at[1:][k], right_at[:-1][k], right_at[1:][k], differ[k], same[k]])) for d in np.unique(depth) for k in [np.flatnonzero(depth == d)]]
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > WALKED:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
            continue
        size = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        done = (size <= DIRECT) | (bit == BITS)
        if done.any():
            a0, _, b0, b1, _, alike = pairs[:, done]
            size, wide = size[done], b1 - b0
            owner = np.repeat(np.arange(len(size)), size)
            nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            a, b = a0[owner] + nth // wide[owner], b0[owner] + nth % wide[owner]
            near = np.bitwise_count(left[a] ^ right[b]) <= most
            near &= ~((alike[owner] == 1) & (left[a] >= right[b]))
            hits.append((a[near], b[near]))
            pairs = pairs[:, ~done]
        if not pairs.shape[1]:
            continue
        a0, a1, b0, b1, d, alike = pairs
        in_a, in_b = set_before(0, bit), set_before(1, bit)
        am, bm = a1 - (in_a[a1] - in_a[a0]), b1 - (in_b[b1] - in_b[b0])
        no = np.zeros_like(alike)
        below = np.concatenate([np.stack([a0, am, b0, bm, d, alike]), np.stack([am, a1, bm, b1, d, alike]), np.stack([a0, am, bm, b1, d + 1, no]), np.stack([am, a1, b0, bm, d + 1, no])[:, alike == 0]], axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= most)]
        if below.shape[1]:
            stack.append((bit + 1, below))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value that links, with the least value of what hangs together with it, unless that is itself."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(values))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            away = root != np.arange(len(values))
            return values[away], values[root[away]]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def links(pairs: DataFrame, most: int) -> DataFrame:
    """``a, b``: fingerprints that hang together, as stars of each batch, from ``small_pairs``."""

    def laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(column.flatten(), np.int64).view(np.uint64), np.asarray(column.offsets, np.int64) - column.offsets[0].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            ends = sum(np.cumsum(np.diff(np.asarray(whole.column(c).offsets, np.int64))) for c in ("left", "right"))
            start = 0
            while start < whole.num_rows:
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + TAKEN, side="right")))
                batch = whole.slice(start, end - start)
                start = end
                left, left_at = laid(batch.column("left"))
                right, right_at = laid(batch.column("right"))
                differ, depth = (np.asarray(batch.column(c), np.int64) for c in ("differ", "depth"))
                same = batch.column("same").to_numpy(zero_copy_only=False).astype(np.int64)
                a, b = walked(left, left_at, right, right_at, differ, same, depth, most)
                if len(a):
                    one, root = forest(left[a], right[b])
                    yield pa.record_batch([pa.array(one.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])
        tidy()

    return pairs.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MOST, leaf: int = LEAF) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, kept``."""
    rows = written(fingerprints(docs, id_col, text_col, words), "prints")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(SALTS)).alias("salt")
    known = rows.where("doc_id is not null").select("print", salt, "doc_id")
    parts = written(known.groupBy("print", "salt").agg(F.min("doc_id").alias("id")), "print-parts")
    nodes = written(parts.groupBy("print").agg(F.min("id").alias("id")), "print-nodes")
    near = links(small_pairs(nodes.select("print"), most, leaf), most).distinct()
    ends = [nodes.select(F.col("print").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab"]
    found = near.join(ends[0], "a").join(ends[1], "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    again = known.groupBy("doc_id").agg(F.min("print").alias("least"), F.max("print").alias("print")).where("least <> print")
    if not again.isEmpty():
        # Rows of one id link their fingerprints.
        own = known.join(again.select("doc_id"), "doc_id", "left_semi").join(nodes, "print")
        found = found.unionByName(own.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    roots = written(connected(written(found, "links")), "roots")
    named = nodes.join(roots, "id", "left").select("print", F.coalesce("root", "id").alias("root"))
    named = parts.select("print", "salt").join(named, "print")
    out = rows.withColumn("salt", salt).join(named, ["print", "salt"], "left")
    root = F.when(F.col("doc_id").isNotNull(), F.col("root"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents kept, one of each component, with their own columns."""
    name = unused(docs, "gone")
    gone = components(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
