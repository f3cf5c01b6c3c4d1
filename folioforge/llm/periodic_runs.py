"""Runs of words that repeat with a period, found by counting matches at each lag.

A run is a longest stretch of consecutive words in which words ``period`` apart are the same,
of at least three periods and ``LEAST`` words; its period is the smallest that it has. Such a
run shows as many matches at the lag of its period as it has words beyond its first period, so
the matches of every lag up to a third of the text are counted first:

* *light* words, by the differences of their places, pair by pair, for a whole batch at once;
* *heavy* words, whose pairs would cost more, by an exact autocorrelation: the squared spectra
  of their places are summed, and one inverse FFT gives their matches at all lags.

Only lags with matches enough for a run are scanned for islands, in ascending order. A run of
period d also matches at the multiples of d; those matches can't be part of a run of any other
period there (two such runs share fewer words than the larger period), so they are taken off
the counts of these lags, and a text of one word over and over is scanned once. A scan looks at
every ``lag / 8`` th place before it looks at all.

Every row is a matter of its own: no shuffle, and a task holds a slice of a batch. Texts of any
length go through whole; time is about n log n, and memory grows with the longest text of a task.

Cases: a null or empty text, or one of white space, has no words and no runs; of equally strong
runs the first by start, then period, is the strongest; rows that repeat an id are rows of
their own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import WORD, slices, texts_of, tidy

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
#: Looks of a scan per period before it looks at every place.
LOOKS = 8

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n long, runs array<{RUN}>, strongest {RUN}, collapsed string"
WORDS = re.compile(WORD)


def fft_size(n: int) -> int:
    """A power of two that holds a text's places and the lags asked for without wrapping around."""
    return 1 << max(n + n // TIMES - 1, 1).bit_length()


def heavy_matches(places: list[np.ndarray], n: int) -> np.ndarray:
    """Pairs of equal words at each lag from 1 to a third of n, of the words with these places."""
    size = fft_size(n)
    power = np.zeros(size // 2 + 1)
    for at in places:
        here = np.zeros(size)
        here[at] = 1.0
        spectrum = np.fft.rfft(here)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[1 : n // TIMES + 1]).astype(np.int64)


def lag_matches(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of each text at its lags 1, 2, ... n // 3, text after text, and the texts' offsets in them.

    ``words`` numbers the words of all texts, no number in two texts; ``at`` has the texts' offsets.
    """
    sizes = np.diff(at)
    top = sizes // TIMES
    base = np.concatenate(([0], np.cumsum(top)))
    counts = np.zeros(int(base[-1]), np.int64)
    if not len(counts):
        return counts, base
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(words, kind="stable")
    word = words[order]
    first = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(word)]))
    frequency, owner = np.diff(first), text[order[first[:-1]]]
    # Heavy is a word whose pairs cost more than a transform of its text's length.
    cost = np.array([fft_size(n) * np.log2(fft_size(n)) for n in sizes.tolist()])
    heavy = frequency.astype(np.float64) ** 2 > 0.5 * cost[owner]
    for t in np.unique(owner[heavy]).tolist():
        hot = np.flatnonzero(heavy & (owner == t)).tolist()
        counts[base[t] : base[t + 1]] += heavy_matches([order[first[w] : first[w + 1]] - at[t] for w in hot], int(sizes[t]))
    # The k-th next place of the same word, for growing k; a lag beyond the text's last one ends a place's part.
    last = np.repeat(first[1:] - 1, frequency)
    alive = np.flatnonzero(~np.repeat(heavy, frequency))
    found, held, k = [], 0, 1
    while len(alive):
        alive = alive[alive + k <= last[alive]]
        lag = order[alive + k] - order[alive]
        owner = text[order[alive]]
        near = lag <= top[owner]
        alive = alive[near]
        found.append(base[owner[near]] + lag[near] - 1)
        held += len(alive)
        k += 1
        if held > 1 << 20 or not len(alive):
            counts += np.bincount(np.concatenate(found), minlength=len(counts))
            found, held = [], 0
    return counts, base


def asked(lag: np.ndarray) -> np.ndarray:
    """Matches of a run of this period at least."""
    return np.maximum(LEAST - lag, (TIMES - 1) * lag)


def islands(words: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch whose words repeat at a lag and that is long enough for a run."""
    need = max(LEAST - lag, (TIMES - 1) * lag)
    step = lag // LOOKS
    if step > 1:
        here = np.arange(0, len(words) - lag, step)
        if _longest(words[here] != words[here + lag]) < need // step:
            return
    gaps = np.concatenate(([-1], np.flatnonzero(words[lag:] != words[:-lag]), [len(words) - lag]))
    for i in np.flatnonzero(np.diff(gaps) > need).tolist():
        yield int(gaps[i]) + 1, int(gaps[i + 1]) + lag


def _longest(different: np.ndarray) -> int:
    return int(np.diff(np.concatenate(([-1], np.flatnonzero(different), [len(different)]))).max()) - 1


def runs_of(words: np.ndarray, matches: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and period of each run of one text, by start and then period; uses up ``matches``."""
    out: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    need = asked(np.arange(1, len(matches) + 1))
    for q in (np.flatnonzero(matches >= need) + 1).tolist():
        if matches[q - 1] < need[q - 1]:
            continue
        for start, end in islands(words, q):
            if (start, end) in known:
                continue
            known.add((start, end))
            out.append((start, end - start, q))
            more = np.arange(2 * q, min(end - start, len(matches) + 1), q)
            matches[more - 1] -= end - start - more
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length per period, compared exactly; the first of equals in their order."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stand in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] > 0


def found_in(texts: list[str]) -> Iterator[tuple[int, list, tuple | None, str]]:
    """Number of words, runs, the strongest run and the text without repeats, of each text."""
    split, numbers, fresh = [WORDS.findall(t) for t in texts], [], 0
    for words in split:
        seen: dict[str, int] = {}
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + fresh)
        fresh += len(seen)
    at = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
    counts, base = lag_matches(np.concatenate(numbers), at)
    lags = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base)) + 1
    likely = np.unique(np.searchsorted(base, np.flatnonzero(counts >= asked(lags)), side="right") - 1)
    likely = set(likely.tolist())
    for i, words in enumerate(split):
        runs = runs_of(numbers[i], counts[base[i] : base[i + 1]]) if i in likely else []
        if runs:
            gone = repeated(len(words), runs)
            words = [w for w, dropped in zip(words, gone.tolist(), strict=True) if not dropped]
        yield len(split[i]), runs, strongest(runs), " ".join(words)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, runs, strongest, collapsed`` of each row; ``collapsed`` is the words kept, joined by spaces."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    shown = lambda run: dict(zip(("start", "length", "period"), run, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                n, runs, best, text = zip(*found_in(texts_of(batch.column(1))), strict=True)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array([[shown(r) for r in x] for x in runs], pa.list_(kind)), pa.array([x and shown(x) for x in best], kind), pa.array(text, pa.string())]
                yield pa.record_batch(columns, ["doc_id", "n", "runs", "strongest", "collapsed"])
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def made_periodic(text: Column, words: Column, start: Column, period: Column) -> Column:
    """The text whose words from ``start`` on repeat the first ``period`` of them up to its end."""
    rest = F.size(words) - start
    cycle = F.slice(words, start + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / period).cast("int"))), F.lit(1), rest)
    return F.coalesce(F.array_join(F.concat(F.slice(words, F.lit(1), start), tail), " "), text)
