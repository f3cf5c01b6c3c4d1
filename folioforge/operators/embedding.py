"""Embedding: pooling, canonical vectors, reuse of what is stored, integrity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.hashing import checksum


def pooled(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Token states (texts x tokens x dim) to one vector each."""
    m = mask.astype(np.float64)
    if how == "cls":
        return states[:, 0]
    if how == "mean":
        return (states * m[:, :, None]).sum(1) / np.maximum(m.sum(1), 1e-12)[:, None]
    if how == "last":
        return states[np.arange(len(states)), np.maximum(m.sum(1).astype(int) - 1, 0)]
    raise ValueError(f"no pooling {how!r}")


def normal(vectors: np.ndarray) -> np.ndarray:
    if not np.isfinite(vectors).all():
        raise ValueError("a vector isn't finite")
    n = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)


def canonical(vector: np.ndarray) -> np.ndarray:
    """As stored: single precision, of length 1 to its last bit but a few."""
    v = np.asarray(vector, np.float32)
    if not np.isfinite(v).all():
        raise ValueError("a vector isn't finite")
    n = float(np.linalg.norm(v.astype(np.float64)))
    return (v.astype(np.float64) / n).astype(np.float32) if n and abs(n - 1) >= 2.0**-23 else v


def batch_size(window: int, most: int = 64, tokens: int = 16384) -> int:
    return max(1, min(most, tokens // max(1, window)))


def batch_sizes(window: Column, most: int = 64, tokens: int = 16384) -> Column:
    """``batch_size`` of a column of windows."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(tokens) / F.greatest(window, F.lit(1))))).cast("long")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed hashes of words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return normal(out).astype(np.float32)

    return embed


def embedded(texts: DataFrame, embed: Callable[[list[str]], np.ndarray], text_col: str = "embed_text") -> DataFrame:
    """Adds ``vector``: every distinct text is embedded once, then joined back by its digest.

    The texts under a digest are compared where they meet, so no text gets another one's vector.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(list(embed(list(t)))) if len(t) else pd.Series([], dtype=object)

    keyed = texts.withColumn("__key", F.sha2(text_col, 256))
    known = keyed.where(F.col(text_col).isNotNull())
    once = known.groupBy("__key").agg(F.min(text_col).alias("__text"), F.max(text_col).alias("__other"))
    made = once.select("__key", F.when(F.col("__text") == F.col("__other"), F.col("__text")).otherwise(F.raise_error(F.lit("two texts of one digest"))).alias("__text"))
    # Marked so that no filter on the vectors is pushed below and makes them twice.
    vector = run.asNondeterministic()("__text").alias("vector")
    return keyed.join(made.select("__key", vector), "__key", "left").drop("__key")


def embed_or_reuse(chunks: DataFrame, stored: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``chunk_id, vector, origin``: by id and identity, else by identity alone, else embedded.

    ``chunks``: ``chunk_id, identity, embed_text``; ``stored``: ``chunk_id, identity, vector``.
    """
    by_id = stored.select("chunk_id", F.col("identity").alias("__i1"), F.col("vector").alias("__v1"))
    by_identity = stored.groupBy("identity").agg(F.min_by("vector", "chunk_id").alias("__v2"))
    joined = chunks.join(by_id, "chunk_id", "left").join(by_identity, "identity", "left")
    same = F.col("__i1") == F.col("identity")
    origin = F.when(same, "reused").when(F.col("__v2").isNotNull(), "moved").when(F.col("__i1").isNotNull(), "input_changed").otherwise("first_seen")
    told = joined.withColumn("origin", origin).withColumn("kept", F.when(same, F.col("__v1")).otherwise(F.col("__v2")))
    have = told.where("kept is not null").select("chunk_id", F.col("kept").alias("vector"), "origin")
    new = embedded(told.where("kept is null").select("chunk_id", "embed_text", "origin"), embed).select("chunk_id", "vector", "origin")
    return have.unionByName(new)


def classified(vectors: DataFrame, dim: int, identity: Column) -> DataFrame:
    """``chunk_id, state``: absent, corrupt, stale or readable."""
    v = F.col("vector")
    broken = (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("chunk_id", F.when(v.isNull(), "absent").when(broken, "corrupt").when(~F.col("identity").eqNullSafe(identity), "stale").otherwise("readable").alias("state"))


def integrity(vectors: DataFrame) -> DataFrame:
    """``chunk_id, integrity`` of ``chunk_id, vector, checksum``: missing, verified or mismatch."""
    return vectors.select("chunk_id", F.when(F.col("checksum").isNull(), "missing").when(F.col("checksum") == checksum("vector"), "verified").otherwise("mismatch").alias("integrity"))


def backfilled(vectors: DataFrame) -> DataFrame:
    """With every missing checksum made."""
    return vectors.withColumn("checksum", F.coalesce("checksum", checksum("vector")))


def table_name(fingerprint: str) -> str:
    """Directory of the vectors of one embedding fingerprint."""
    return f"vectors_{hashlib.sha256(fingerprint.encode()).hexdigest()[:8]}"


def over_budget(chunks: DataFrame, most: int) -> DataFrame:
    """One row: chunks that a model's window can't take, and the longest."""
    return chunks.agg(F.count_if(F.col("token_count") > most).alias("over"), F.coalesce(F.max("token_count"), F.lit(0)).alias("longest"))


def require_within(chunks: DataFrame, most: int) -> None:
    """Refuse a run whose longest chunk a model's window can't take, before anything is embedded."""
    row = over_budget(chunks, most).first()
    if row["over"]:
        raise ValueError(f"{row['over']} chunks are above {most} tokens, the longest has {row['longest']}")
