"""Saved pages and snapshot directories as sources.

A snapshot is a directory with a manifest of its bodies; a body counts only if its digest is
the manifest's. A saved page carries its metadata in the page itself, in a definition list or
a two-column table, which a profile names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "id STRING, title STRING, file STRING, sha256 STRING, version STRING"


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """``id, title, version, content, outcome`` of every manifest line: taken, missing or checksum."""
    lines = spark.read.schema(MANIFEST).json(f"{root}/manifest.jsonl", mode="FAILFAST")
    bodies = spark.read.format("binaryFile").load(f"{root}/bodies").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")
    joined = lines.join(bodies, "file", "left")
    outcome = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.lower("sha256"), "checksum").otherwise("taken")
    return joined.select("id", "title", "version", F.when(outcome == "taken", F.col("content")).alias("content"), outcome.alias("outcome"))


@dataclass(frozen=True)
class Profile:
    """Where a kind of saved page keeps its body, and which of its labels mean what."""

    name: str
    body: str = "article"
    labels: tuple[tuple[str, str], ...] = (("title", "title"), ("author", "author"), ("updated", "updated"), ("id", "id"))


class _Saved(HTMLParser):
    def __init__(self, profile: Profile) -> None:
        super().__init__(convert_charrefs=True)
        self.p, self.meta, self.label, self.text, self.inside = profile, {}, None, None, 0
        self.body: list[str] = []
        self.known = dict(profile.labels)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == self.p.body:
            self.inside += 1
        elif self.inside:
            shown = "".join(f' {k}="{v or ""}"' for k, v in attrs)
            self.body.append(f"<{tag}{shown}>")
        if tag in ("dt", "dd", "th", "td", "title"):
            self.text = ""

    def handle_endtag(self, tag: str) -> None:
        if tag == self.p.body and self.inside:
            self.inside -= 1
        elif self.inside:
            self.body.append(f"</{tag}>")
        if tag in ("dt", "th") and self.text is not None:
            self.label = self.text.strip().rstrip(":").lower()
        elif tag in ("dd", "td") and self.text is not None and self.label in self.known:
            self.meta.setdefault(self.known[self.label], self.text.strip())
        elif tag == "title" and self.text is not None:
            self.meta.setdefault("title", " ".join(self.text.split()))
        if tag in ("dt", "dd", "th", "td", "title"):
            self.text = None

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text += data
        if self.inside:
            self.body.append(data.replace("&", "&amp;").replace("<", "&lt;"))


def adapted(pages: DataFrame, profiles: tuple[Profile, ...], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, profile, title, author, updated, declared_id, body, outcome`` by the first profile that finds a body."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, html in zip(f["id"], f["html"], strict=True):
                best = (i, None, None, None, None, None, None, "no_profile" if html else "empty")
                for p in profiles if html else ():
                    parser = _Saved(p)
                    parser.feed(html)
                    parser.close()
                    if body := "".join(parser.body).strip():
                        m = parser.meta
                        best = (i, p.name, m.get("title"), m.get("author"), m.get("updated"), m.get("id"), body, "adapted")
                        break
                rows.append(best)
            yield pd.DataFrame(rows, columns=["id", "profile", "title", "author", "updated", "declared_id", "body", "outcome"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, profile string, title string, author string, updated string, declared_id string, body string, outcome string")
