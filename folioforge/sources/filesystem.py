"""Files as a source: discovery, media types, version tokens, identities, watermarks."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.text import extension

#: Media types by suffix (fixed values).
MEDIA_TYPES = {
    ".txt": "text/plain", ".text": "text/plain", ".log": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".mdx": "text/mdx", ".html": "text/html", ".htm": "text/html", ".xhtml": "application/xhtml+xml",
    ".pdf": "application/pdf", ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json", ".yaml": "application/yaml", ".yml": "application/yaml", ".toml": "application/toml", ".xml": "application/xml", ".eml": "message/rfc822", ".zip": "application/zip",
    ".ipynb": "application/x-ipynb+json", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".py": "text/x-python", ".js": "text/javascript", ".ts": "text/x-typescript", ".java": "text/x-java", ".c": "text/x-c", ".cpp": "text/x-c++", ".go": "text/x-go", ".rs": "text/x-rust", ".rb": "text/x-ruby", ".sh": "text/x-shellscript", ".sql": "application/sql", ".dot": "text/vnd.graphviz", ".mmd": "text/vnd.mermaid",
    ".jsx": "text/javascript", ".mjs": "text/javascript", ".tsx": "text/x-typescript", ".kt": "text/x-kotlin", ".scala": "text/x-scala", ".cs": "text/x-csharp", ".h": "text/x-c", ".hpp": "text/x-c++", ".cc": "text/x-c++", ".swift": "text/x-swift", ".php": "text/x-php", ".pl": "text/x-perl", ".lua": "text/x-lua",
    ".bash": "text/x-shellscript", ".r": "text/x-r", ".jl": "text/x-julia", ".hs": "text/x-haskell", ".ex": "text/x-elixir", ".exs": "text/x-elixir", ".erl": "text/x-erlang", ".dart": "text/x-dart", ".css": "text/css", ".gv": "text/vnd.graphviz", ".adf": "application/vnd.document-nodes+json", ".storage": "application/vnd.wiki.storage+xml",
}
IGNORED_DIRS = ("node_modules", "__pycache__", ".git", ".venv", "venv", "dist", "build")
SIDECAR = ".meta.json"


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path matches one of the shell patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(fnmatch.translate(p).replace("\\Z", "$").replace("\\z", "$").replace("(?s:", "(?s)(?:"))
    return out


def discover(spark: SparkSession, root: str, hidden: bool = False, most_bytes: int | None = None) -> DataFrame:
    """``path, source_id, media_type, version_token, length`` of the files below ``root``, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    base = F.regexp_extract(F.col("path"), f"^(?:file:)?/*{root.removeprefix('file:').strip('/')}/(.*)$", 1)
    rows = files.withColumn("source_id", base).where("source_id <> ''")
    parts = F.split("source_id", "/")
    rows = rows.where(~F.exists(parts, lambda p: p.isin(*IGNORED_DIRS))).where(~F.col("source_id").endswith(SIDECAR))
    if not hidden:
        rows = rows.where(~F.exists(parts, lambda p: p.startswith(".")))
    if most_bytes is not None:
        rows = rows.where(F.col("length") <= most_bytes)
    return rows.select("path", "source_id", media_type(F.col("path")).alias("media_type"), version_token(F.unix_micros("modificationTime"), F.col("length")).alias("version_token"), "length")


def fetch(spark: SparkSession, root: str, wanted: DataFrame, most_listed: int = 10_000) -> DataFrame:
    """Content of the discovered files in ``wanted``; nothing outside ``root`` can be named.

    Up to ``most_listed`` files are read by their names, so an almost unchanged corpus costs as much as
    its changes; beyond that all of ``root`` is read once and joined.
    """
    listed = [r[0] for r in wanted.select("path").limit(most_listed + 1).collect()]
    if not listed:
        return wanted.select("path").withColumn("content", F.lit(None).cast("binary")).join(wanted, "path").limit(0)
    reader = spark.read.format("binaryFile")
    files = reader.load([_escaped(p) for p in listed]) if len(listed) <= most_listed else reader.option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").join(wanted, "path")


def _escaped(path: str) -> str:
    """A path that names itself where patterns are read."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def version_token(*stamps: Column) -> Column:
    return F.concat_ws("+", *[s.cast("string") for s in stamps])


def identities(files: DataFrame) -> DataFrame:
    """``path, source_id, conflict`` from ``path, declared_id``: an id that several files claim is nobody's."""
    claims = F.count("declared_id").over(Window.partitionBy("declared_id"))
    conflict = F.col("declared_id").isNotNull() & (claims > 1)
    return files.withColumn("conflict", conflict).select("path", F.when(F.col("conflict") | F.col("declared_id").isNull(), F.col("path")).otherwise(F.col("declared_id")).alias("source_id"), "conflict")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Declared metadata beside the files: ``path`` of the document and the declared fields."""
    fields = "id STRING, title STRING, uri STRING, version STRING, sha256 STRING, section_path ARRAY<STRING>"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SIDECAR}").load(root)
    parsed = files.select(F.expr(f"left(path, length(path) - {len(SIDECAR)})").alias("path"), F.from_json(F.col("content").cast("string"), fields).alias("m"))
    return parsed.select("path", "m.*")


def accepted_sidecars(declared: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds ``refused``: why a manifest isn't taken, null if it is."""
    joined = declared.join(contents.select("path", F.sha2("content", 256).alias("__sha")), "path", "left")
    reason = F.when(F.col("__sha").isNull(), "no document").when(F.col("sha256").isNotNull() & (F.lower("sha256") != F.col("__sha")), "checksum").when(F.length("title") > 1024, "title").when(F.col("uri").isNotNull() & ~F.col("uri").rlike("^https?://[^/]+"), "uri").when(F.size("section_path") > 32, "sections")
    return joined.withColumn("refused", reason).drop("__sha")


def watermarks(seen: DataFrame, carried: DataFrame, complete: Column | None = None) -> DataFrame:
    """``space, position``: the newest time per space, carried forward where nothing is new; moved only
    where the enumeration was complete (a column of ``seen``, true if not given)."""
    s = seen.withColumn("__done", F.lit(True) if complete is None else complete)
    new = s.groupBy("space").agg(F.max("when").alias("__new"), F.bool_and("__done").alias("__ok"))
    joined = carried.join(new, "space", "full_outer")
    return joined.select("space", F.coalesce(F.when(F.col("__ok"), F.greatest("__new", "position")), "position").alias("position"))


def resumed(watermark: DataFrame, scope: str) -> DataFrame:
    """Positions taken under another scope don't count."""
    return watermark.withColumn("position", F.when(F.col("scope") == scope, F.col("position")))


def since(position: Column, overlap_minutes: int) -> Column:
    """Start of the next listing: the minute of the position, less the overlap."""
    return F.date_trunc("minute", position - F.make_interval(mins=F.lit(overlap_minutes)))


def covering_roots(pages: DataFrame, roots: list[str]) -> DataFrame:
    """Pages at or below the roots: ``page_id, roots``, from ``page_id, ancestors``."""
    wanted = F.array(*[F.lit(r) for r in roots])
    chain = F.concat("ancestors", F.array("page_id"))
    return pages.select("page_id", F.array_sort(F.array_intersect(chain, wanted)).alias("roots")).where(F.size("roots") > 0)


def same_origin(base: Column, link: Column) -> Column:
    from folioforge.functions.text import origin_of

    return origin_of(base).eqNullSafe(origin_of(link))


def quoted(text: str) -> str:
    """A literal of a query language in double quotes."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def content_query(space: str, types: tuple[str, ...], since_minute: str | None = None, roots: tuple[str, ...] = ()) -> str:
    """Clauses joined by AND; ids of roots are digits only."""
    if any(not r.isdigit() for r in roots):
        raise ValueError("an id is digits only")
    clauses = [f"space = {quoted(space)}", f"type in ({', '.join(quoted(t) for t in types)})"]
    if since_minute:
        clauses.append(f"lastmodified >= {quoted(since_minute)}")
    if roots:
        ids = ", ".join(roots)
        clauses.append(f"(id in ({ids}) or ancestor in ({ids}))")
    return " AND ".join(clauses)


def title_query(title: str, space: str | None = None) -> str:
    """A page by its title, in one space if one is named."""
    return " AND ".join(([f"space = {quoted(space)}"] if space else []) + [f"title = {quoted(title)}"])


def status_clause(statuses: tuple[str, ...]) -> str:
    """Rows of any of the statuses; none restricts nothing."""
    return f"status IN ({', '.join(quoted(s) for s in sorted(set(statuses)))})" if statuses else ""


def next_page(payload: Column, base: Column) -> Column:
    """Where the next page of a listing is, null at its end; a link to another origin is null too, and never followed."""
    link = F.get_json_object(payload, "$._links.next")
    origin = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]+)", 1)
    whole = F.when(link.startswith("/") & ~link.startswith("//"), F.concat(origin, link)).otherwise(link)
    return F.when(link.isNotNull() & same_origin(base, whole), whole)


def inside(root: str, paths: DataFrame) -> DataFrame:
    """Paths that lie below a local root once links are followed: ``path, inside``. One that can't be resolved is outside."""
    import os

    @F.pandas_udf("boolean")
    def below(path: pd.Series) -> pd.Series:
        top = os.path.realpath(root.removeprefix("file:"))
        local = path.str.replace(r"^file:/*", "/", regex=True)
        return local.map(lambda p: os.path.exists(p) and os.path.commonpath([top, os.path.realpath(p)]) == top)

    return paths.withColumn("inside", below("path"))
