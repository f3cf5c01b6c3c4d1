"""How query modules collect what they register."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            self.QUERIES[fn.__name__] = fn
            if sql:
                self.SQL[fn.__name__] = sql
            return fn

        return add
