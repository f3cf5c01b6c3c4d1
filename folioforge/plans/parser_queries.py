"""Registered queries of the parsers: each writes a body of one format for every supplier, and its SQL says what must be read."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Callable
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import chunking, parsing
from folioforge.operators import vendor as V
from folioforge.plans import fixtures as fx
from folioforge.plans.registry import Registry

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
OFFICE = "application/vnd.openxmlformats-officedocument."


def _bodies(spark: SparkSession, sf_dir: str, media_type: str, write: Callable[[int, str], bytes]) -> DataFrame:
    """``document_id, content, media_type``: one body per supplier, written from its key and name."""

    @F.pandas_udf("binary")
    def made(key: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([write(int(k), n) for k, n in zip(key, name, strict=True)])

    # Dealt, as rows of a few bytes become bodies that take milliseconds each.
    s = fx.dealt(fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))
    return s.select(F.col("s_suppkey").alias("document_id"), made("s_suppkey", "s_name").alias("content"), F.lit(media_type).alias("media_type"))


def _read(spark: SparkSession, sf_dir: str, media_type: str, write: Callable[[int, str], bytes]) -> DataFrame:
    rows = parsing.blocks(parsing.parsed(_bodies(spark, sf_dir, media_type, write)))
    return rows.select("document_id", "position", "kind", "text", F.array_join("heading_path", " > ").alias("heading"))


def _want(*rows: tuple[str, str, str]) -> str:
    """SQL of the blocks of each supplier: ``kind, text, heading`` as expressions over ``s_suppkey AS k, s_name AS n``."""
    one = "SELECT s_suppkey AS document_id, {i}::INTEGER AS position, '{kind}' AS kind, {text} AS text, {heading} AS heading FROM (SELECT *, s_suppkey AS k, s_name AS n FROM supplier)"
    return " UNION ALL ".join(one.format(i=i, kind=kind, text=text, heading=heading) for i, (kind, text, heading) in enumerate(rows))


def _zip(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


@query(_want(("prose", "n || chr(10) || 'line ' || k", "''"), ("prose", "'second'", "''")))
def prs01_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "text/plain", lambda k, n: f"{n}\nline {k}\n\n  \nsecond\n".encode())


@query(_want(("heading", "n", "n"), ("prose", "'About ' || n || '.'", "n"), ("heading", "'Part'", "n || ' > Part'"), ("code", "'x = ' || k", "n || ' > Part'")))
def prs02_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "text/markdown", lambda k, n: f"# {n}\n\nAbout {n}.\n\n## Part\n\n```py\nx = {k}\n```\n".encode())


@query(_want(("heading", "n", "n"), ("prose", "'About ' || n || ' & more.'", "n"), ("list", "'- one' || chr(10) || '- ' || k", "n"), ("table", "'a | b' || chr(10) || k || ' | 2'", "n")))
def prs03_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "text/html", lambda k, n: f"<html><head><style>p{{}}</style></head><body><script>no()</script><h1>{n}</h1><p>About <b>{n}</b> &amp; more.</p><ul><li>one<li>{k}</ul><table><tr><th>a<th>b</tr><tr><td>{k}</td><td>2</td></tr></table></body></html>".encode())


@query(_want(("prose", "n || chr(10) || 'Row ' || k", "''")))
def prs04_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(k: int, n: str) -> bytes:
        content = zlib.compress(f"BT /F1 12 Tf 10 20 Td ({n}) Tj T* [(Ro) -20 (w {k})] TJ ET".encode())
        return b"%PDF-1.4\n1 0 obj\n<< /Type /Pages /Kids [2 0 R] >>\nendobj\n2 0 obj\n<< /Type /Page /Contents 3 0 R >>\nendobj\n3 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + content + b"\nendstream\nendobj\n"

    return _read(spark, sf_dir, "application/pdf", write)


@query(_want(("heading", "n", "n"), ("prose", "'About ' || k", "n"), ("list", "'- a' || chr(10) || '- b'", "n"), ("table", "'x | y' || chr(10) || k || ' | 2'", "n")))
def prs05_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(k: int, n: str) -> bytes:
        p = lambda t, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
        cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
        item = "<w:numPr/>"
        body = p(n, '<w:pStyle w:val="Heading1"/>') + p(f"About {k}") + p("a", item) + p("b", item) + f"<w:tbl><w:tr>{cell('x')}{cell('y')}</w:tr><w:tr>{cell(k)}{cell(2)}</w:tr></w:tbl>"
        return _zip(word__document_xml=f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')

    return _read(spark, sf_dir, OFFICE + "wordprocessingml.document", write)


@query(_want(("heading", "n", "n"), ("prose", "'Text ' || k", "n")))
def prs06_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(k: int, n: str) -> bytes:
        shape = lambda t, ph: f'<p:sp><p:nvSpPr>{ph}</p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
        title = '<p:ph type="title"/>'
        return _zip(ppt__slides__slide1_xml=f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a">{shape(n, title)}{shape(f"Text {k}", "")}</p:sld>')

    return _read(spark, sf_dir, OFFICE + "presentationml.presentation", write)


@query(_want(("table", "'name | key'", "'S'"), ("table", "n || ' | ' || k", "'S'")))
def prs07_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(k: int, n: str) -> bytes:
        cell = lambda at, t: f'<c r="{at}" t="inlineStr"><is><t>{t}</t></is></c>'
        rows = f'<row>{cell("A1", "name")}{cell("B1", "key")}</row><row>{cell("A2", n)}<c r="B2"><v>{k}</v></c></row>'
        return _zip(xl__workbook_xml='<workbook xmlns="urn:x"><sheets><sheet name="S"/><sheet name="H" state="hidden"/></sheets></workbook>', xl__worksheets__sheet1_xml=f'<worksheet xmlns="urn:x"><sheetData>{rows}</sheetData></worksheet>')

    return _read(spark, sf_dir, OFFICE + "spreadsheetml.sheet", write)


@query(_want(("table", "'name | key'", "''"), ("table", "n || ', x | ' || k", "''")))
def prs07_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "text/csv", lambda k, n: f'name,key\r\n"{n}, x",{k}\r\n\r\n'.encode())


@query(_want(("heading", "n", "n"), ("code", "'x = ' || k", "n"), ("code", "k::VARCHAR", "n")))
def prs08_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(k: int, n: str) -> bytes:
        cells = [{"cell_type": "markdown", "source": [f"# {n}\n"]}, {"cell_type": "code", "source": f"x = {k}", "outputs": [{"text": [str(k)]}]}]
        return json.dumps({"cells": cells, "metadata": {"language_info": {"name": "python"}}}).encode()

    return _read(spark, sf_dir, "application/x-ipynb+json", write)


@query(_want(("panel", "'From: a@example.com' || chr(10) || 'Subject: ' || n", "''"), ("prose", "'Body ' || k", "''")))
def prs09_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(k: int, n: str) -> bytes:
        m = EmailMessage()
        m["From"], m["Subject"] = "a@example.com", n
        m.set_content(f"Body {k}\n")
        m.add_alternative(f"<p>Body {k}</p>", subtype="html")
        return m.as_bytes()

    return _read(spark, sf_dir, "message/rfc822", write)


@query(_want(("code", "'{'", "''"), ("code", "'  \"name\": \"' || n || '\",'", "'name'"), ("code", "'  \"key\": ' || k || chr(10) || '}'", "'key'")))
def prs10_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "application/json", lambda k, n: json.dumps({"name": n, "key": k}, indent=2).encode())


@query(_want(("code", "'name: ' || n", "'name'"), ("code", "'key:' || chr(10) || '  - ' || k", "'key'")))
def prs10_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "application/yaml", lambda k, n: f"name: {n}\nkey:\n  - {k}\n".encode())


@query(_want(("code", "'name = \"' || n || '\"'", "'name'"), ("code", "'[part]' || chr(10) || 'key = ' || k", "'part'")))
def prs10_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "application/toml", lambda k, n: f'name = "{n}"\n\n[part]\nkey = {k}\n'.encode().replace(b"]\nkey", b"]\nkey"))


@query(_want(("code", "'import os'", "''"), ("code", "'# ' || n || chr(10) || 'def f_' || k || '():' || chr(10) || '    return ' || k", "'f_' || k"), ("code", "'class C:' || chr(10) || '    pass'", "'C'")))
def prs11_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "text/x-python", lambda k, n: f"import os\n\n# {n}\ndef f_{k}():\n    return {k}\n\nclass C:\n    pass\n".encode())


#: A definition named ``f_N`` in each language, with a comment above it and one more definition below.
SOURCES = {
    "javascript": ("// {n}\nfunction f_{k}() {{\n  return 1;\n}}", "class B {{\n}}"),
    "typescript": ("// {n}\nexport async function f_{k}(): number {{\n  return 1;\n}}", "interface B {{\n}}"),
    "java": ("// {n}\npublic final class f_{k} {{\n}}", "interface B {{\n}}"),
    "kotlin": ("// {n}\nfun f_{k}() = 1", "data class B(val x: Int)"),
    "scala": ("// {n}\ndef f_{k} = 1", "case class B(x: Int)"),
    "csharp": ("// {n}\npublic class f_{k} {{\n}}", "struct B {{\n}}"),
    "c": ("// {n}\nint f_{k}(void) {{\n  return 1;\n}}", "struct B {{\n}};"),
    "c++": ("// {n}\nstd::vector<int> f_{k}(int x) {{\n  return 1;\n}}", "namespace B {{\n}}"),
    "go": ("// {n}\nfunc f_{k}() {{\n}}", "type B struct {{\n}}"),
    "rust": ("// {n}\npub fn f_{k}() {{\n}}", "struct B {{\n}}"),
    "swift": ("// {n}\nfunc f_{k}() {{\n}}", "struct B {{\n}}"),
    "ruby": ("# {n}\ndef f_{k}\nend", "class B\nend"),
    "php": ("// {n}\nfunction f_{k}() {{\n}}", "class B {{\n}}"),
    "perl": ("# {n}\nsub f_{k} {{\n}}", "package B;"),
    "lua": ("-- {n}\nfunction f_{k}()\nend", "local function B()\nend"),
    "shell": ("# {n}\nf_{k}() {{\n  true\n}}", "B() {{\n  true\n}}"),
    "sql": ("-- {n}\nCREATE TABLE f_{k} (x int);", "create or replace view B AS SELECT 1;"),
    "r": ("# {n}\nf_{k} <- function(x) {{\n}}", "B <- function(x) 1"),
    "julia": ("# {n}\nfunction f_{k}(x)\nend", "struct B\nend"),
    "haskell": ("-- {n}\nf_{k} :: Int", "data B = B"),
    "elixir": ("# {n}\ndefmodule f_{k} do\nend", "defmodule B do\nend"),
    "erlang": ("% {n}\nf_{k}(X) -> X.", "b(X) -> X."),
    "dart": ("// {n}\nint f_{k}(int x) {{\n}}", "class B {{\n}}"),
    "css": ("/* {n} */\n.f_{k} {{\n  top: 0;\n}}", "b {{\n}}"),
}
_MEDIA = {lang: next(m for m, chain in parsing.CHAINS.items() if chain and chain[0].__name__ == f"source_{''.join(c for c in lang if c.isalpha())}" and (lang != "c" or m == "text/x-c") and (lang != "c++" or m == "text/x-c++")) for lang in SOURCES}
_ORDER = sorted(SOURCES)


@query(
    "WITH l(i, lang, b) AS (VALUES " + ", ".join(f"({i}, '{lang}', '{'b' if lang in ('erlang', 'css') else 'B'}')" for i, lang in enumerate(_ORDER)) + f""")
SELECT s_suppkey AS document_id, lang, 2 AS n, CASE lang WHEN 'css' THEN '.' ELSE '' END || 'f_' || s_suppkey || ',' || b AS names, true AS commented FROM supplier JOIN l ON i = s_suppkey % {len(_ORDER)}"""
)
def prs11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-11: the definitions of one language per supplier, with the comment above theirs."""
    s = fx.dealt(fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))
    media, texts = [F.lit(_MEDIA[lang]) for lang in _ORDER], ["\n\n".join(SOURCES[lang]).replace("{{", "{").replace("}}", "}") for lang in _ORDER]
    at = (F.col("s_suppkey") % len(_ORDER) + 1).cast("int")
    text = F.replace(F.replace(F.element_at(F.array(*[F.lit(t) for t in texts]), at), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{n}"), F.col("s_name"))
    raw = s.select(F.col("s_suppkey").alias("document_id"), F.encode(text, "UTF-8").alias("content"), F.element_at(F.array(*media), at).alias("media_type"))
    b = parsing.blocks(parsing.parsed(raw)).join(s.select(F.col("s_suppkey").alias("document_id"), "s_name"), "document_id")
    named = b.groupBy("document_id").agg(F.min("lang").alias("lang"), F.count(F.lit(1)).cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.array_join("heading_path", "/").alias("h")))), lambda x: x["h"]), ",").alias("names"), F.bool_or((F.col("position") == 0) & F.contains("text", "s_name")).alias("commented"))
    return named.select("document_id", "lang", "n", "names", "commented")


@query(_want(("heading", "n", "n"), ("prose", "'See Page ' || k || ' now'", "n"), ("panel", "'Take care'", "n"), ("code", "'x = ' || k", "n"), ("list", "'1. a' || chr(10) || '2. b'", "n"), ("table", "'h | i' || chr(10) || k || ' | 2'", "n")))
def prs12_storage_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(k: int, n: str) -> bytes:
        link = f'<ac:link><ri:page ri:content-title="Page {k}"/></ac:link>'
        code = f'<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[x = {k}]]></ac:plain-text-body></ac:structured-macro>'
        panel = '<ac:structured-macro ac:name="warning"><ac:rich-text-body><p>Take care</p></ac:rich-text-body></ac:structured-macro>'
        return f"<h1>{n}</h1><p>See&nbsp;{link} now</p>{panel}{code}<ol><li>a</li><li>b</li></ol><table><tbody><tr><th>h</th><th>i</th></tr><tr><td>{k}</td><td>2</td></tr></tbody></table>".encode()

    return _read(spark, sf_dir, "application/vnd.wiki.storage+xml", write)


@query(_want(("heading", "n", "n"), ("prose", "'See https://e.org/' || k", "n"), ("panel", "'Take care'", "n"), ("code", "'x = ' || k", "n"), ("list", "'- a' || chr(10) || '- b'", "n"), ("table", "'h | i' || chr(10) || k || ' | 2'", "n")))
def prs12_document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(k: int, n: str) -> bytes:
        t = lambda s: {"type": "text", "text": str(s)}
        p = lambda *x: {"type": "paragraph", "content": list(x)}
        row = lambda kind, *x: {"type": "tableRow", "content": [{"type": kind, "content": [p(t(v))]} for v in x]}
        nodes = [
            {"type": "heading", "attrs": {"level": 1}, "content": [t(n)]},
            p(t("See "), {"type": "inlineCard", "attrs": {"url": f"https://e.org/{k}"}}),
            {"type": "panel", "content": [p(t("Take care"))]},
            {"type": "codeBlock", "attrs": {"language": "py"}, "content": [t(f"x = {k}")]},
            {"type": "bulletList", "content": [{"type": "listItem", "content": [p(t(v))]} for v in "ab"]},
            {"type": "table", "content": [row("tableHeader", "h", "i"), row("tableCell", k, 2)]},
        ]
        return json.dumps({"type": "doc", "version": 1, "content": nodes}).encode()

    return _read(spark, sf_dir, "application/vnd.document-nodes+json", write)


@query("SELECT s_suppkey AS document_id, 'Start to ' || s_name || ': go' || chr(10) || s_name || ' to End' || chr(10) || 'Box holds End' || chr(10) || 'alone' AS said FROM supplier")
def prs12_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-12: what is embedded of a diagram, in either language: its edges, groups and what no edge meets."""

    def write(k: int, n: str) -> bytes:
        if k % 2:
            return f'digraph g {{\n  a [label="Start"];\n  b [label="{n}"];\n  a -> b [label="go"];\n  b -> c;\n  subgraph cluster_0 {{ label="Box"; c; }}\n  c [label="End"];\n  alone;\n}}'.encode()
        return f"graph TD\n  a[Start] -->|go| b[{n}]\n  b --> c[End]\n  subgraph Box\n    c\n  end\n  alone\n  %% a comment that makes the source longer than what is said of it\n".encode()

    raw = _bodies(spark, sf_dir, "text/vnd.graphviz", write).withColumn("media_type", F.when(F.col("document_id") % 2 == 1, "text/vnd.graphviz").otherwise("text/vnd.mermaid"))
    chunks = chunking.chunked(parsing.parsed(raw).withColumn("title", F.lit("")), chunking.Budget(400, 32, 32, 32))
    return chunks.select("document_id", F.col("embed_text").alias("said"))


@query("SELECT s_suppkey AS document_id, 'a.txt' AS path, s_name AS text FROM supplier UNION ALL SELECT s_suppkey, 'c.zip!deep.txt', 'key ' || s_suppkey FROM supplier")
def prs13_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-13: members of archives, nested ones too; what leaves the archive is refused."""

    def write(k: int, n: str) -> bytes:
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("deep.txt", f"key {k}")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.txt", n)
            z.writestr("../b.txt", n)
            z.writestr("c.zip", inner.getvalue())
        return out.getvalue()

    found = parsing.expanded(_bodies(spark, sf_dir, "application/zip", write)).where("refused is null")
    return found.select("document_id", "path", F.col("content").cast("string").alias("text"))


@query("SELECT s_suppkey AS document_id, CASE s_suppkey % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'failed' WHEN 2 THEN 'unsupported_media_type' ELSE 'no_extractable_text' END AS status FROM supplier")
def prs14_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-14: what becomes of a body that its parser reads, fails on, doesn't know, or finds nothing in."""
    raw = _bodies(spark, sf_dir, "", lambda k, n: [n.encode(), b"PK broken", b"x", b" \n\n"][k % 4])
    k = F.col("document_id") % 4
    typed = raw.withColumn("media_type", F.when(k == 1, OFFICE + "wordprocessingml.document").when(k == 2, "application/x-unknown").otherwise("text/plain"))
    return parsing.parsed(typed).select("document_id", "status")


@query("SELECT s_suppkey AS document_id, (p - 1)::INTEGER AS position, t AS resolved FROM (SELECT s_suppkey, unnest([s_name || chr(10) || 'two', 'key ' || s_suppkey]) AS t, unnest([1, 2]) AS p FROM supplier)")
def prs16_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-16: a block's anchor read back against its body."""
    raw = _bodies(spark, sf_dir, "text/plain", lambda k, n: f"{n}\ntwo\n\n\nkey {k}".encode())

    @F.pandas_udf("string")
    def resolve(anchor: pd.Series, content: pd.Series) -> pd.Series:
        return anchor.combine(content, lambda a, c: parsing.resolved(a, bytes(c)))

    b = parsing.blocks(parsing.parsed(raw)).join(raw.select("document_id", "content"), "document_id")
    return b.select("document_id", "position", resolve("anchor", "content").alias("resolved"))


@query("SELECT s_suppkey AS document_id, 3 AS n_chunks, true AS within, true AS whole, true AS headed FROM supplier")
def chk03_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-02 to CHK-08: a text of ten sentences in chunks of a budget: none above it, nothing lost, each under its heading."""

    def write(k: int, n: str) -> bytes:
        words = [f"{'W' if i % 12 == 1 else 'w'}{(i * 7 + k) % 50}" + ("." if i % 12 == 0 else "") for i in range(1, 121)]
        return f"# {n}\n\n{' '.join(words)}\n".encode()

    raw = _bodies(spark, sf_dir, "text/markdown", write)
    budget = chunking.Budget(70, 0, 8, 16)
    c = chunking.chunked(parsing.parsed(raw).withColumn("title", F.lit("")), budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ")
    per = c.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), F.bool_and(F.col("token_count") <= 70).alias("within"), F.regexp_replace(joined, r"\s+", " ").alias("all"), F.bool_and(F.size("heading_path") == 1).alias("headed"))
    want = F.regexp_replace(F.decode("content", "UTF-8"), r"(?s)^# [^\n]*\s+|\s+$", "")
    return per.join(raw, "document_id").select("document_id", "n_chunks", "within", (F.col("all") == want).alias("whole"), "headed")
