"""Toxicity by compression distance between two trained zstandard dictionaries.

A text, A-Z lower-cased, is cut at spaces into windows. Each window is compressed with a
dictionary trained on toxic text and with one trained on ordinary text; a window that the
toxic one makes shorter speaks for toxicity. Most of a toxic document is ordinary text, so
the toxic dictionary is trained on the stretches of toxic documents whose byte strings occur
in more toxic than ordinary documents beyond chance, and it ends with the ordinary
dictionary's content: what both know cancels out. The mean and the extremes of the windows'
differences give the score through a logistic calibration, whose prior is the labels' own.

The fit is on a sample of labelled documents bounded by ``SAMPLE`` per class, chosen by a hash
of their ids; of a text longer than ``LONGEST_SAMPLE`` characters it takes a stretch of that
length, placed by the same hash. All else covers all documents and whole texts. Labels and ids
are no inputs of a score.

Cases: null is empty; a very long text has all its windows; an empty text has no window and the score of no evidence; ties in the
sample are broken by id; without labels of both classes every score is the share of toxic
labels (0.5 without any); repeated rows stay; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import bounded_sample, stretch, utf8_of

SAMPLE = 1500
LONGEST_SAMPLE = 20_000
WINDOW = 320
DICT_BYTES = 8_192
LEVEL = 6
#: Optimal parsing in two passes, with matches from three bytes on: lazier choices outweigh the dictionaries' difference.
PARSE = {"strategy": zstandard.STRATEGY_BTULTRA2, "min_match": 3, "window_log": 15, "hash_log": 15, "chain_log": 15, "search_log": 6, "target_length": 64}
#: Length of the byte strings that are compared; the z-score and the share of toxic documents from which one
#: speaks for toxicity (copies of one document make up less).
GRAM, Z, LEAST_SHARE = 6, 6.0, 0.02
FEATURES = 6


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Whole words, ``size`` bytes or a little more each; a word without a space for 4 sizes is cut."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = text.find(b" ", at + size, at + 4 * size)
        end = min(n, at + 4 * size) if end < 0 and n - at > size else (n if end < 0 else end)
        out.append(text[at:end])
        at = end
    return out


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(**PARSE, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how)


def differences(parts: list[bytes], toxic, ordinary) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    a, b = toxic.compress, ordinary.compress
    return np.array([len(b(p)) - len(a(p)) for p in parts], np.float64)


def summary(diff: np.ndarray) -> list[float]:
    """Features of a document's windows."""
    if not len(diff):
        return [0.0] * FEATURES
    top = np.sort(diff)[::-1]
    n = len(diff)
    return [float(diff.mean()), float(top[0]), float(top[: max(1, n // 4)].mean()), float(top[-1]), float(diff.mean() * np.sqrt(n)), float(np.log1p(n))]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.toxic, self.ordinary = (_compressor(model.toxic), _compressor(model.ordinary)) if model.toxic else (None, None)

    def score(self, text: bytes) -> float:
        m = self.model
        x = summary(differences(windows(text.lower()), self.toxic, self.ordinary)) if self.toxic else [0.0] * FEATURES
        z = m.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(m.weights[1:], x, m.center, m.scale, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _dictionary(samples: list[bytes]) -> bytes:
    """Content of a trained dictionary; of few samples, the most frequent of them."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        counted = sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0]))
        return b"".join(t for t, _ in counted)[:DICT_BYTES]


def _grams(text: bytes) -> np.ndarray:
    """Every byte string of GRAM bytes, as integers."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) < GRAM:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(b) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        out = (out << np.uint64(8)) | b[j : len(b) - GRAM + 1 + j]
    return out


def _stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Stretches of toxic documents, one for each occurrence, that speak for toxicity."""
    counts = []
    for side in (toxic, ordinary):
        counts.append(np.unique(np.concatenate([np.unique(_grams(t)) for t in side] or [np.zeros(0, np.uint64)]), return_counts=True))
    grams, bad = counts[0]
    at = np.searchsorted(counts[1][0], grams)
    at = np.minimum(at, max(0, len(counts[1][0]) - 1))
    good = np.where(counts[1][0][at] == grams, counts[1][1][at], 0) if len(counts[1][0]) else np.zeros(len(grams))
    pooled = (bad + good) / (len(toxic) + len(ordinary))
    z = (bad / len(toxic) - good / len(ordinary)) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / len(toxic) + 1 / len(ordinary)))
    telling = grams[(z > Z) & (bad >= max(3, LEAST_SHARE * len(toxic)))]
    out = []
    for t in toxic:
        hit = np.isin(_grams(t), telling)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        out += [t[a : b + GRAM - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return out


def _pair(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    plain = _dictionary([w for t in ordinary for w in windows(t)])
    stretches = _stretches(toxic, ordinary)
    counted = sorted(Counter(stretches).items(), key=lambda x: (-x[1], x[0]))
    # The most frequent stretches whole, then, in what room they leave, what training finds in the rest; a trained
    # dictionary has its header in front and its best content at the end, so it is cut in front.
    often = b" ".join(t for t, n in counted if n > 2)[:DICT_BYTES]
    room = DICT_BYTES - len(often)
    rest = _dictionary(stretches)[-room:] if stretches and room else b""
    return rest + b" " + often + b" " + plain, plain


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method."""
    x = np.hstack((np.ones((len(x), 1)), x))
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """From texts of both classes; ``share`` is that of toxic ones among all labels."""
    none = ((0.0,) * FEATURES, (1.0,) * FEATURES)
    share = min(max(share, 1e-3), 1 - 1e-3)
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * FEATURES), *none)
    sides = [[t.lower() for t in side] for side in (toxic, ordinary)]
    # Calibrated on dictionaries that haven't met the document: each half is measured by the other's.
    x, y = [], []
    for half in (0, 1):
        pair = [_compressor(d) for d in _pair(*[side[half::2] for side in sides])]
        for label, side in zip((1, 0), sides, strict=True):
            for t in side[1 - half :: 2]:
                x.append(summary(differences(windows(t), *pair)))
                y.append(label)
    xa, ya = np.array(x), np.array(y, np.float64)
    center, scale = xa.mean(0), xa.std(0) + 1e-6
    w = _logistic((xa - center) / scale, ya)
    w[0] += np.log(share / (1 - share)) - np.log(ya.mean() / (1 - ya.mean()))
    t, o = _pair(*sides)
    return Model(t, o, tuple(map(float, w)), tuple(map(float, center)), tuple(map(float, scale)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, longest: int = LONGEST_SAMPLE) -> Model:
    """Fit on a bounded sample of ``labels`` (``doc_id, toxic``), which must hold training rows only."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    ids = bounded_sample(known, "toxic", "doc_id", sample)  # the bound of what is broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), stretch(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col), longest).alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    found = [[r["text"].encode() for r in rows if r["toxic"] == label] for label in (1, 0)]
    return fit(found[0], found[1], bad / n if n else 0.5)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES and a few numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([scorer.score(t) for t in utf8_of(batch.column(1))], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, score double")
