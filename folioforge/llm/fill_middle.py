"""Fill-in-the-middle forms of texts, cut between units of letters.

A unit is a run of A-Z letters of either case, or any other single code point. The
tokenizers library's ``Split`` pre-tokenizer isolates every match of that pattern and gives
the code-point offsets at which units begin: their number is n, and the offsets of the two
ranks drawn are where prefix, middle and suffix are sliced. Nothing is trained.

Both ranks, whether a text is rearranged at all, and in which order its parts stand come from
a SHA-256 of the row's id, so reruns and retries of a task agree. Every row is a matter of its
own: no shuffle, and a task holds a slice of a batch and the offsets of one block of a text.

Cases: a null text counts as empty, has no unit and stays plain; so does a text that holds one
of the marks; a very long text is split in blocks, none of which ends inside a run of letters;
rows that repeat an id are drawn alike; a row without an id is drawn as for an empty id; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import slices, texts_of, tidy

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Percent of texts that are rearranged, and percent of these with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Code points that the pre-tokenizer gets at once, which bounds its alignments' memory.
BLOCK = 1 << 16

LETTERS = re.compile("[A-Za-z]*")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(UNIT), "isolated")


def blocks(text: str, size: int = BLOCK) -> Iterator[tuple[int, str]]:
    """Consecutive parts of a text with their first code points; a run of letters stays in one."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text) and LETTERS.match(text, end - 1).end() > end:
            end = LETTERS.match(text, end).end()
        yield start, text[start:end]
        start = end


def unit_offsets(text: str, splitter, size: int = BLOCK) -> np.ndarray:
    """The code points at which units begin, in order."""
    parts = [np.array([span[0] for _, span in splitter.pre_tokenize_str(part)], np.int64) + start for start, part in blocks(text, size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of an id."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(raw[i : i + 4], "big") for i in range(0, 16, 4)]


def rearranged(text: str, doc_id: int | None, starts: np.ndarray, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, str]:
    """Form, code points of prefix and of middle, and the output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    n = len(starts)
    ranks = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(starts[r]) if r < n else len(text) for r in ranks)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = unit_splitter()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids, made = batch.column(0).to_pylist(), []
                for doc_id, text in zip(ids, texts_of(batch.column(1)), strict=True):
                    starts = unit_offsets(text, splitter)
                    made.append((len(starts), *rearranged(text, doc_id, starts, seed, rate, suffix_first)))
                n, form, prefix, middle, output = zip(*made, strict=True)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.record_batch(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    No part holds a mark and no mark begins with another's end, so the first place of a mark
    is the mark itself.
    """

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        head = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(head) + len(second) + 1)
        tail = F.substring_index(rest, MIDDLE, 1)
        return head, tail, F.substr(rest, F.length(tail) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)
