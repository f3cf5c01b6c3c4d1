"""What several operators of this subpackage share: reading tables, Arrow batches, tokens."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What stands for a null id inside files and bins; it comes first, and is null again in results.
NO_ID = -(1 << 63)


def known_id(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def shown_id(column: Column) -> Column:
    return F.when(column != NO_ID, column)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, UPPER.lower())


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def utf8_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty, without decoding them."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets of its rows in them; a null row is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a text column holds about ``most_bytes`` in each part, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = np.concatenate(([0], np.cumsum([v.as_py() or 0 for v in _lengths(batch.column(column))], dtype=np.int64)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(sizes, sizes[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def _lengths(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.binary_length(column)


def stretch(text: Column, id_col: Column, longest: int) -> Column:
    """The text, or of a longer one ``longest`` characters from a place that a hash of its id chooses."""
    at = F.pmod(F.xxhash64(id_col.cast("string"), F.lit(1)), F.length(text) - longest + 1) + 1
    return F.when(F.length(text) > longest, F.substr(text, at.cast("int"), F.lit(longest))).otherwise(text)


def bounded_sample(rows: DataFrame, group: str, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, chosen by a hash of their ids.

    Counts come first, so that a hash limit leaves few more rows than are asked for; only
    those are ordered. Only groups that need a limit are gathered.
    """
    known = rows.where(F.col(group).isNotNull())
    large = known.groupBy(group).count().where(F.col("count") > 2 * most + 64).collect()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    if large:
        kind = rows.schema[group].dataType
        limits = F.create_map(*[x for name, n in large for x in (F.lit(name).cast(kind), F.lit(-(-(1 << 30) * 2 * most // n) + (1 << 30) * 64 // n))])
        known = known.where(draw < F.coalesce(F.try_element_at(limits, F.col(group)), F.lit(1 << 30)))
    order = Window.partitionBy(group).orderBy("__draw", F.col(id_col))
    return known.withColumn("__draw", draw).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__draw", "__n")


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition; one run at a time is held."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.asarray(batch.column(key))
        if not len(keys):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and keys[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def tidy() -> None:
    """At the end of a task: give freed memory back, as workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class FastEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The byte-level pre-tokenizer of these vocabularies never joins characters over a space
    that precedes a non-space, so texts are cut there. Each distinct piece of a batch goes
    through the tokenizer once while it stays in a bounded cache, and the texts' ids are
    gathered by piece. Texts that hold an added token's own string are encoded whole; so is
    every text if the pre-tokenizer is of another kind.
    """

    #: Longer pieces and words are encoded anew each time, which bounds the caches' bytes.
    LONGEST_CACHED = 64
    #: Any white space of any definition after a space, or a space at the end.
    BAD_SPACE = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"

    def __init__(self, path: str, cached: int = 250_000):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cached = cached
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.good_space = re.compile(r" (?=\S)")
        # Letters of the Latin blocks make one pre-token, and so does a run of marks after them.
        self.simple = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(kept)))}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece as it stands after a space."""
        found, odd, tokenize, simple, shown, words = {}, [], self.tokenizer.model.tokenize, self.simple, self.shown, self.words
        code = "H" if self.dtype.itemsize == 2 else "I"
        for p in pieces:
            if (m := simple(p)) is None:
                odd.append(p)
                continue
            word, marks = m.groups()
            if (ids := words.get(word)) is None:
                shape = word if word.isascii() else word.encode().decode("latin-1").translate(shown)
                ids = array(code, [t.id for t in tokenize("\u0120" + shape)]).tobytes()
                if len(word) <= self.LONGEST_CACHED:
                    words[word] = ids
            if marks:
                if (after := words.get(marks)) is None:
                    after = array(code, [t.id for t in tokenize(marks)]).tobytes()
                    if len(marks) <= self.LONGEST_CACHED:
                        words[marks] = after
                ids += after
            found[p] = ids
        if len(words) > self.cached:
            words.clear()
        found.update(zip(odd, self._whole([" " + p for p in odd]), strict=True))
        return found

    def _known(self, pieces: list[str]) -> list[bytes]:
        """From the cache of two generations, of which the elder goes when the younger is full."""
        found = list(map(self.young.get, pieces))
        if None in found:
            new = {}
            for i, v in enumerate(found):
                if v is None:
                    p = pieces[i]
                    if (v := self.old.get(p)) is not None:
                        found[i] = self.young[p] = v
                    else:
                        new[p] = None
            new = self._learn(list(new))
            found = [new[p] if v is None else v for p, v in zip(pieces, found, strict=True)]
            self.young.update(new)
            for p in [p for p in new if len(p) > self.LONGEST_CACHED]:
                del self.young[p]
            if len(self.young) > self.cached:
                self.old, self.young = self.young, {}
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of ``dtype``."""
        if not text:
            return b""
        if not self.by_piece or any(a in text for a in self.added):
            return self._whole([text])[0]
        first, *rest = self.good_space.split(text)
        return (self._whole([first])[0] if first else b"") + b"".join(self._known(rest))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the offsets of the rows in them; a null row has none."""
        import pyarrow.compute as pc

        column = column.cast(pa.large_string()).fill_null("")
        alone = pc.equal(pc.binary_length(column), 0)
        if self.by_piece:
            for a in self.added:
                alone = pc.or_(alone, pc.match_substring(column, a))
            alone = pc.or_(alone, pc.match_substring_regex(column, self.BAD_SPACE)).to_numpy(zero_copy_only=False)
        else:
            alone = np.ones(len(column), bool)
        lists = pc.split_pattern(column.filter(pa.array(~alone)), " ")
        pieces, cuts = lists.flatten(), np.asarray(lists.offsets, np.int64)
        firsts = cuts[:-1] - cuts[0]
        coded = pieces.dictionary_encode()
        index, words = np.asarray(coded.indices, np.int64), self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        heads = pieces.take(pa.array(firsts)).dictionary_encode()
        index[firsts] = len(words) + np.asarray(heads.indices, np.int64)
        words += self._whole(heads.dictionary.to_pylist())
        alone_ids = [self.encode(t) for t in column.filter(pa.array(alone)).to_pylist()]
        step = self.dtype.itemsize
        # One list of parts in row order: the pieces of cut rows, the whole ids of the others.
        per_row = np.ones(len(column), np.int64)
        per_row[~alone] = np.diff(cuts)
        ends = np.cumsum(per_row)
        part = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        is_alone = np.zeros(len(part), bool)
        is_alone[(ends - per_row)[alone]] = True
        part[~is_alone] = index
        part[is_alone] = len(words) + np.arange(len(alone_ids))
        words += alone_ids
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // step
        starts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(words), self.dtype)
        long = sizes[part]
        before = np.cumsum(long) - long
        ids = pool[np.repeat(starts[part] - before, long) + np.arange(int(long.sum()))]
        return ids, np.concatenate(([0], np.cumsum(long)))[np.concatenate(([0], ends))]
