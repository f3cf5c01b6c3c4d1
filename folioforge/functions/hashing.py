"""Identifiers and checksums. BLAKE2b, HMAC and byte-exact vector sums run in Arrow batches: the
engine has no function for them."""

from __future__ import annotations

import hashlib
import hmac
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest(*parts: bytes | str | None) -> str:
    """BLAKE2b of 128 bits over the parts, each after its length in eight bytes; a null part has a length of its own."""
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        if p is None:
            h.update(b"\xff" * 8)
            continue
        raw = p.encode() if isinstance(p, str) else p
        h.update(len(raw).to_bytes(8, "big") + raw)
    return h.hexdigest()


@F.pandas_udf(T.StringType())
def content_hash(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else digest(bytes(c) if not isinstance(c, str) else c))


@F.pandas_udf(T.StringType())
def document_id(workspace: pd.Series, source: pd.Series, source_id: pd.Series) -> pd.Series:
    return pd.Series([digest("document", w, s, i) for w, s, i in zip(workspace, source, source_id, strict=True)])


@F.pandas_udf(T.StringType())
def chunk_id(document: pd.Series, position: pd.Series, text: pd.Series) -> pd.Series:
    """From the content, so that a chunk that stays the same keeps its id."""
    return pd.Series([digest("chunk", d, str(p), t) for d, p, t in zip(document, position, text, strict=True)])


@F.pandas_udf(T.StringType())
def _vector_id(publication: pd.Series, chunk: pd.Series) -> pd.Series:
    return pd.Series([digest("vector", p, c) for p, c in zip(publication, chunk, strict=True)])


def vector_id(publication: Column, chunk: Column) -> Column:
    return F.when(publication == "legacy", chunk).otherwise(_vector_id(publication, chunk))


@F.pandas_udf(T.StringType())
def glossary_entry_id(chunk: pd.Series, acronym: pd.Series, expansion: pd.Series) -> pd.Series:
    return pd.Series([digest("glossary", c, a, e) for c, a, e in zip(chunk, acronym, expansion, strict=True)])


def plain_digest(*parts: Column) -> Column:
    """The same scheme over SHA-256, cut to 128 bits: all in expressions, checkable in SQL."""
    sized = [F.concat(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0"), F.hex(p)) for p in parts]
    return F.substring(F.sha2(F.concat(*sized), 256), 1, 32)


@F.pandas_udf(T.StringType())
def embedding_identity(document: pd.Series, fingerprint: pd.Series, text: pd.Series) -> pd.Series:
    """What an embedding was made of: SHA-256 of compact JSON in ASCII."""
    return pd.Series([hashlib.sha256(json.dumps([1, d, f, [], t], ensure_ascii=True, separators=(",", ":")).encode()).hexdigest() for d, f, t in zip(document, fingerprint, text, strict=True)])


def vector_checksum(vector: np.ndarray, domain: bytes = b"vector-checksum-v1") -> str:
    """SHA-256 over the domain, the length and the components as big-endian floats, -0.0 as 0.0."""
    v = np.asarray(vector, np.float32) + np.float32(0.0)
    return hashlib.sha256(domain + len(v).to_bytes(8, "big") + v.astype(">f4").tobytes()).hexdigest()


@F.pandas_udf(T.StringType())
def checksum(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else vector_checksum(v))


def keyed_hash(key: bytes):
    """HMAC-SHA-256 of a text under ``key``, its first 16 hexadecimal digits."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest()[:16])

    return run


def fingerprint(fields: dict) -> str:
    """Canonical JSON of an identity; two are equal if their strings are."""
    return json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
