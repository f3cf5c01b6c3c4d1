"""Named components and the hooks around them: how an application puts an engine together.

A component is a plain callable of one of the kinds below. The registry holds factories by kind
and name and refuses what it doesn't know; a container builds each component once, when it is
first asked for, with the settings given for it. Hooks run around a stage over DataFrames: each
may change the rows before and after it, in order of registration before and in reverse after.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame


@runtime_checkable
class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


@runtime_checkable
class Parser(Protocol):
    """Blocks of one body; raises ``ValueError`` for one that it can't read."""

    def __call__(self, raw: bytes) -> list[dict]: ...


@runtime_checkable
class Connector(Protocol):
    """What a source has: rows ``source_id, version_token``, and the bodies of those that are wanted."""

    def discover(self) -> DataFrame: ...

    def fetch(self, wanted: DataFrame) -> DataFrame: ...


@runtime_checkable
class Reranker(Protocol):
    """Candidates ``query_id, chunk_id, score`` in a new order, with the texts of both sides."""

    def __call__(self, candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame: ...


#: Kinds of components by name.
KINDS: dict[str, type] = {"embedder": Embedder, "parser": Parser, "connector": Connector, "reranker": Reranker}


class UnknownComponent(KeyError):
    """A kind or name that nothing is registered for."""


@dataclass
class Registry:
    _made: dict[tuple[str, str], Callable[..., Any]] = field(default_factory=dict)

    def add(self, kind: str, name: str, factory: Callable[..., Any]) -> None:
        """A name is given once; another factory under it is refused, not replaced."""
        if kind not in KINDS:
            raise UnknownComponent(kind)
        if (kind, name) in self._made:
            raise ValueError(f"{kind} {name} is registered already")
        self._made[kind, name] = factory

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._made if k == kind)

    def make(self, kind: str, name: str, **settings: Any) -> Any:
        if (kind, name) not in self._made:
            raise UnknownComponent(f"{kind} {name}; there are {', '.join(self.names(kind)) or 'none'}")
        made = self._made[kind, name](**settings)
        if not isinstance(made, KINDS[kind]):
            raise TypeError(f"{name} doesn't do what a {kind} does")
        return made


@dataclass
class Container:
    """Components by role, as settings choose them: ``{"embedder": {"name": "hashing", "dim": 64}}``."""

    registry: Registry
    settings: dict[str, dict[str, Any]]
    _built: dict[str, Any] = field(default_factory=dict)

    def get(self, kind: str) -> Any:
        if kind not in self._built:
            chosen = dict(self.settings.get(kind) or {})
            if "name" not in chosen:
                raise UnknownComponent(f"no {kind} is chosen")
            self._built[kind] = self.registry.make(kind, chosen.pop("name"), **chosen)
        return self._built[kind]


class Hook:
    """What runs around a stage; either side may be left as it is."""

    def before(self, stage: str, rows: DataFrame) -> DataFrame:
        return rows

    def after(self, stage: str, rows: DataFrame) -> DataFrame:
        return rows


def hooked(stage: str, run: Callable[[DataFrame], DataFrame], hooks: list[Hook]) -> Callable[[DataFrame], DataFrame]:
    """A stage with its hooks around it."""

    def whole(rows: DataFrame) -> DataFrame:
        for h in hooks:
            rows = h.before(stage, rows)
        rows = run(rows)
        for h in reversed(hooks):
            rows = h.after(stage, rows)
        return rows

    return whole


def defaults() -> Registry:
    """What this package itself has to offer."""
    from folioforge.operators import embedding, parsing, retrieval

    registry = Registry()
    registry.add("embedder", "hashing", embedding.hashing_embedder)
    for name, parser in {"text": parsing.plaintext, "markdown": parsing.markdown, "html": parsing.html}.items():
        registry.add("parser", name, lambda parser=parser: parser)
    registry.add("reranker", "overlap", lambda k=50: lambda c, chunks, queries: retrieval.overlap_rerank(c, chunks, queries, k))
    return registry
