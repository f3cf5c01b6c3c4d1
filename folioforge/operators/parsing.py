"""Bytes to anchored blocks. Each parser turns one document into blocks; a row keeps its failure as a
status and never fails the task. What needs a library that isn't there (PDF) is unsupported.

A block is a dict with ``kind, text, heading_path, lang, start, end, anchor, header_rows``; anchors are
``line:a-b``, ``heading:slug``, ``cell:sheet!A1:B2``, ``page:n`` or ``unlocated:reason``.
"""

from __future__ import annotations

import ast
import csv
import email
import email.policy
import hashlib
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = 60
BLOCKS = "array<struct<kind:string,text:string,heading_path:array<string>,lang:string,start:int,end:int,anchor:string,header_rows:int>>"


class Declined(Exception):
    """The bytes aren't of this parser's kind."""


def block(kind: str, text: str, path: list[str] | tuple = (), start: int = 0, end: int = 0, anchor: str = "", lang: str | None = None, header_rows: int = 0) -> dict:
    return {"kind": kind, "text": text, "heading_path": list(path), "lang": lang, "start": start, "end": end, "anchor": anchor or f"line:{start}-{end}", "header_rows": header_rows}


#: Bytes that texts hardly have (fixed values).
CONTROLS = bytes(b for b in range(32) if not 9 <= b <= 13)


def probably_text(raw: bytes) -> bool:
    head = raw[:8192]
    return b"\0" not in head and (not head or (len(head) - len(head.translate(None, CONTROLS))) / len(head) < 0.05)


def decoded(raw: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def slug(text: str, used: dict[str, int] | None = None) -> str:
    """An anchor of a heading; repeated ones are numbered."""
    s = re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", text.strip().lower())).strip("-")
    if used is None:
        return s
    used[s] = used.get(s, -1) + 1
    return s if used[s] == 0 else f"{s}-{used[s]}"


class Headings:
    """The stack of open headings."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = []
        self.slugs: dict[str, int] = {}

    def enter(self, level: int, text: str) -> list[str]:
        self.open = [h for h in self.open if h[0] < level] + [(level, text)]
        return self.path

    @property
    def path(self) -> list[str]:
        return [t for _, t in self.open]


def plaintext(raw: bytes, most: int = LINES) -> list[dict]:
    """Paragraphs between blank lines, of ``most`` lines at most."""
    if not probably_text(raw):
        raise Declined("not text")
    out: list[dict] = []
    held: list[str] = []
    first = 1
    for n, line in enumerate([*decoded(raw).splitlines(), ""], 1):
        if line.strip():
            held, first = ([line], n) if not held else ([*held, line], first)
        if held and (not line.strip() or len(held) == most):
            out.append(block("prose", "\n".join(held), (), first, first + len(held) - 1))
            held = []
    return out


def markdown(raw: bytes) -> list[dict]:
    """Front matter hidden, headings, fences, tables, lists and paragraphs; components stand as media."""
    lines = decoded(raw).splitlines()
    heads, out, i = Headings(), [], 0
    if lines and lines[0].strip() == "---":
        close = next((k for k in range(1, len(lines)) if lines[k].strip() in ("---", "...")), None)
        i = close + 1 if close else 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        j = i + 1
        if m := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            path = heads.enter(len(m[1]), m[2])
            out.append(block("heading", m[2], path, i + 1, i + 1, f"heading:{slug(m[2], heads.slugs)}"))
        elif j < len(lines) and re.fullmatch(r" {0,3}(=+|-+)\s*", lines[j]) and not re.match(r"\s*([-*+]|\d+[.)])\s", line) and "|" not in line:
            path = heads.enter(1 if "=" in lines[j] else 2, line.strip())
            out.append(block("heading", line.strip(), path, i + 1, j + 1, f"heading:{slug(line, heads.slugs)}"))
            j += 1
        elif m := re.match(r" {0,3}(`{3,}|~{3,})\s*([\w+-]*)", line):
            while j < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[j]):
                j += 1
            out.append(block("code", "\n".join(lines[i + 1 : j]), heads.path, i + 1, min(j + 1, len(lines)), lang=m[2] or None))
            j += 1
        elif "|" in line and j < len(lines) and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", lines[j]) and "|" in lines[j]:
            j += 1
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                j += 1
            rows = [[c.strip() for c in r.strip().strip("|").split("|")] for k, r in enumerate(lines[i:j]) if k != 1]
            out.append(block("table", "\n".join(" | ".join(r) for r in rows), heads.path, i + 1, j, header_rows=1))
        elif re.match(r"\s*<[A-Z]\w*", line):
            while j < len(lines) and lines[j].strip():
                j += 1
            out.append(block("media", "\n".join(lines[i:j]), heads.path, i + 1, j))
        else:
            item = re.compile(r"\s*([-*+]|\d+[.)])\s+")
            listed = bool(item.match(line))
            while j < len(lines) and lines[j].strip() and not re.match(r" {0,3}(#{1,6}\s|`{3,}|~{3,})", lines[j]) and (listed or not item.match(lines[j])):
                j += 1
            out.append(block("list" if listed else "prose", "\n".join(s.strip() for s in lines[i:j]), heads.path, i + 1, j))
        i = j
    return out


class _Html(HTMLParser):
    DROP = frozenset("script style noscript template head nav svg iframe".split())
    BLOCK = frozenset("p div section article main aside header footer blockquote figure figcaption dl dt dd address details summary body form ul ol table".split())
    VOID = frozenset("br img hr meta link input area base col embed source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heads, self.out, self.text = Headings(), [], []
        self.skip: list[str] = []
        self.kind, self.level, self.marker, self.pre, self.lang = "prose", 0, "", 0, None
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.head_rows = 0

    def flush(self) -> None:
        text = "".join(self.text)
        text = text.strip("\n") if self.kind == "code" else re.sub(r"\s+", " ", text).strip()
        self.text = []
        if not text:
            return
        if self.kind == "heading":
            self.out.append(block("heading", text, self.heads.enter(self.level, text), anchor=f"heading:{slug(text, self.heads.slugs)}"))
        elif self.kind == "list" and self.out and self.out[-1]["kind"] == "list" and self.out[-1]["heading_path"] == self.heads.path and self.lists and self.lists[-1][1]:
            self.out[-1]["text"] += f"\n{self.marker}{text}"
        else:
            if self.kind == "list" and self.lists:
                self.lists[-1][1] = True
            self.out.append(block(self.kind, f"{self.marker if self.kind == 'list' else ''}{text}", self.heads.path, anchor=f"heading:{slug(self.heads.path[-1]) if self.heads.path else ''}", lang=self.lang if self.kind == "code" else None))

    def end_cell(self) -> None:
        """Close an open cell, whose end tag may be left out."""
        if self.cell is not None and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
        self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in self.DROP:
            self.skip.append(tag)
        if self.skip:
            return
        if tag == "br":
            (self.cell if self.cell is not None else self.text).append("\n" if self.kind == "code" else " ")
        elif tag == "img" and a.get("alt"):
            self.flush()
            self.out.append(block("media", a["alt"], self.heads.path, anchor="unlocated:image"))
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag == "table":
            self.flush()
            self.rows, self.head_rows = [], 0
        elif tag == "tr" and self.rows is not None:
            self.end_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.end_cell()
            self.cell = []
            if tag == "th" and len(self.rows) == self.head_rows + 1 and not self.rows[-1]:
                self.head_rows += 1
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, False, 0])
        elif tag == "li":
            self.flush()
            self.kind = "list"
            if self.lists:
                self.lists[-1][2] += 1
                self.marker = f"{self.lists[-1][2]}. " if self.lists[-1][0] == "ol" else "- "
        elif tag == "pre":
            self.flush()
            self.kind, self.pre, self.lang = "code", 1, None
        if tag == "code" and self.pre and (m := re.search(r"language-([\w+-]+)", a.get("class") or "")):
            self.lang = m[1]
        elif tag in self.BLOCK and self.rows is None and tag not in ("ul", "ol", "table"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
            return
        if re.fullmatch("h[1-6]", tag) or tag in ("li", "pre"):
            self.flush()
            self.kind = "list" if tag == "pre" and self.lists else "prose"
            self.pre = 0
        elif tag in ("td", "th", "tr") and self.cell is not None and self.rows:
            self.end_cell()
        elif tag == "table" and self.rows is not None:
            self.end_cell()
            rows = [r for r in self.rows if any(r)]
            if rows:
                self.out.append(block("table", "\n".join(" | ".join(r) for r in rows), self.heads.path, anchor="unlocated:table", header_rows=min(self.head_rows, len(rows))))
            self.rows = None
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
            self.kind = "list" if self.lists else "prose"
        elif tag in self.BLOCK and self.rows is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.cell if self.cell is not None else self.text).append(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def html(raw: bytes) -> list[dict]:
    p = _Html()
    p.feed(decoded(raw))
    p.close()
    p.flush()
    return p.out


def letters(index: int) -> str:
    out = ""
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _sheet(rows: list[list[str]], name: str) -> list[dict]:
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    return [block("table", " | ".join(r), [name] if name else [], n, n, f"cell:{name}!A{n}:{letters(max(1, len(r)))}{n}") for n, r in enumerate(rows, 1) if any(c.strip() for c in r)]


def spreadsheet_csv(raw: bytes) -> list[dict]:
    text = decoded(raw)
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    return _sheet(list(csv.reader(io.StringIO(text), dialect)), "")


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    root = ET.fromstring(z.read(name))
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def spreadsheet_xlsx(raw: bytes) -> list[dict]:
    """Visible sheets; merged cells hold their first cell's value."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter("t")) for si in _xml(z, "xl/sharedStrings.xml").iter("si")] if "xl/sharedStrings.xml" in names else []
        for i, sheet in enumerate(_xml(z, "xl/workbook.xml").iter("sheet"), 1):
            path = f"xl/worksheets/sheet{i}.xml"
            if sheet.get("state") in ("hidden", "veryHidden") or path not in names:
                continue
            root, cells = _xml(z, path), {}
            for c in root.iter("c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                v = c.find("v")
                text = "".join(t.text or "" for t in c.iter("t")) if c.get("t") == "inlineStr" else ("" if v is None else v.text or "")
                if m and text:
                    kind = c.get("t")
                    cells[int(m[2]), _index(m[1])] = shared[int(text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
            for merge in root.iter("mergeCell"):
                m = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", merge.get("ref", ""))
                if m and (value := cells.get((int(m[2]), _index(m[1])))) is not None:
                    for r in range(int(m[2]), min(int(m[4]), int(m[2]) + 1000) + 1):
                        for c in range(_index(m[1]), min(_index(m[3]), _index(m[1]) + 1000) + 1):
                            cells[r, c] = value
            high = max((r for r, _ in cells), default=0)
            width = max((c for _, c in cells), default=0)
            out += _sheet([[cells.get((r, c), "") for c in range(1, width + 1)] for r in range(1, high + 1)], sheet.get("name", f"Sheet{i}"))
    return out


def _index(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n


def word(raw: bytes) -> list[dict]:
    """Headings by style, runs of list paragraphs as one list, tables by rows."""
    heads, out = Headings(), []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = _xml(z, "word/document.xml").find("body")
        styles = {s.get(next((k for k in s.attrib if k.endswith("styleId")), ""), ""): next((n.get(k, "") for n in s.iter("name") for k in n.attrib), "") for s in _xml(z, "word/styles.xml").iter("style")} if "word/styles.xml" in z.namelist() else {}
    for e in body if body is not None else []:
        if e.tag == "p":
            text = "".join(t.text or "" for t in e.iter("t")).strip()
            style = next((v for s in e.iter("pStyle") for v in s.attrib.values()), "")
            m = re.search(r"heading\s*(\d)", f"{styles.get(style, '')} {style}".lower())
            if not text:
                continue
            if m:
                out.append(block("heading", text, heads.enter(int(m[1]), text), anchor=f"heading:{slug(text, heads.slugs)}"))
            elif e.find(".//numPr") is not None:
                if out and out[-1]["kind"] == "list" and out[-1]["heading_path"] == heads.path:
                    out[-1]["text"] += f"\n- {text}"
                else:
                    out.append(block("list", f"- {text}", heads.path, anchor=f"heading:{slug(heads.path[-1]) if heads.path else ''}"))
            else:
                out.append(block("prose", text, heads.path, anchor=f"heading:{slug(heads.path[-1]) if heads.path else ''}"))
        elif e.tag == "tbl":
            rows = [" | ".join("".join(t.text or "" for t in c.iter("t")).strip() for c in r.iter("tc")) for r in e.iter("tr")]
            if rows:
                out.append(block("table", "\n".join(rows), heads.path, anchor="unlocated:table", header_rows=1 if len(rows) > 1 else 0))
    return out


def slides(raw: bytes) -> list[dict]:
    """Per slide its title as heading, then text, indented text as list, tables; anchors are pages."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for page, name in enumerate(names, 1):
            path: list[str] = []
            for shape in _xml(z, name).iter("sp"):
                paras = [("".join(t.text or "" for t in p.iter("t")).strip(), any(int(x.get("lvl", 0)) > 0 for x in p.iter("pPr"))) for p in shape.iter("p")]
                text = "\n".join(t for t, _ in paras if t)
                if not text:
                    continue
                if any(h.get("type") in ("title", "ctrTitle") for h in shape.iter("ph")):
                    path = [text]
                    out.append(block("heading", text, path, page, page, f"page:{page}"))
                else:
                    out.append(block("list" if any(deep for t, deep in paras if t) else "prose", text, path, page, page, f"page:{page}"))
    return out


def notebook(raw: bytes) -> list[dict]:
    heads, out = Headings(), []
    doc = json.loads(raw)
    lang = doc.get("metadata", {}).get("language_info", {}).get("name") or doc.get("metadata", {}).get("kernelspec", {}).get("language")
    for n, cell in enumerate(doc.get("cells", [])):
        text = "".join(cell.get("source", []))
        anchor = f"heading:cell-{cell.get('id', n)}"
        if cell.get("cell_type") == "markdown":
            for b in markdown(text.encode()):
                if b["kind"] == "heading":
                    b["heading_path"] = heads.enter(len(re.match(r"\s*(#*)", text.splitlines()[b["start"] - 1])[1]) or 1, b["text"])
                else:
                    b["heading_path"] = heads.path
                out.append(b | {"anchor": anchor})
        elif cell.get("cell_type") == "code" and text.strip():
            out.append(block("code", text, heads.path, n, n, anchor, lang))
            for o in cell.get("outputs", []):
                data = "".join(o.get("text", [])) or "".join(o.get("data", {}).get("text/plain", [])) or "\n".join(filter(None, [f"{o.get('ename', '')}: {o.get('evalue', '')}".strip(": "), *o.get("traceback", [])]))
                if data.strip():
                    out.append(block("code", re.sub(r"\x1b\[[0-9;]*m", "", data).strip(), heads.path, n, n, anchor))
    return out


def mail(raw: bytes) -> list[dict]:
    """The header block, then the first plain part, or else the first HTML part."""
    msg = email.message_from_bytes(raw, policy=email.policy.default)
    out = [block("panel", "\n".join(f"{h}: {msg[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if msg[h]), anchor="heading:headers")]
    plain = next((p for p in msg.walk() if p.get_content_type() == "text/plain" and not p.is_attachment()), None)
    rich = next((p for p in msg.walk() if p.get_content_type() == "text/html" and not p.is_attachment()), None)
    if plain is not None:
        out += plaintext(plain.get_content().encode())
    elif rich is not None:
        out += html(rich.get_content().encode())
    return [b for b in out if b["text"]]


def structured_json(raw: bytes) -> list[dict]:
    text = decoded(raw)
    json.loads(text)
    return _marked(text, re.compile(r'^ {2}"((?:[^"\\]|\\.)*)"\s*:'), "json")


def structured_toml(raw: bytes) -> list[dict]:
    text = decoded(raw)
    tomllib.loads(text)
    return _marked(text, _TomlMarks(), "toml")


class _TomlMarks:
    """Keys up to the first table, then tables: a key below a table's head is the table's. Asked line by line."""

    TABLE, KEY = re.compile(r"^\[+([^\]]+)\]+\s*(?:#.*)?$"), re.compile(r"^([A-Za-z0-9_.-]+)\s*=")

    def __init__(self) -> None:
        self.in_table = False

    def match(self, line: str) -> re.Match | None:
        if m := self.TABLE.match(line):
            self.in_table = True
            return m
        return None if self.in_table else self.KEY.match(line)


def structured_yaml(raw: bytes) -> list[dict]:
    if not probably_text(raw):
        raise Declined("not text")
    return _marked(decoded(raw), re.compile(r"^([A-Za-z_][\w.-]*)\s*:"), "yaml")


def _marked(text: str, mark: re.Pattern | _TomlMarks, lang: str, above: re.Pattern | None = None) -> list[dict]:
    """Spans from one top-level key to the next, cut by lines where they are too tall; lines that match ``above``
    right before a key are its own."""
    lines = text.splitlines()
    marks = [(i, next(g for g in m.groups() if g)) for i, line in enumerate(lines) if (m := mark.match(line))]
    for k, (i, name) in enumerate(marks if above else ()):
        floor = marks[k - 1][0] + 1 if k else 0
        while i > floor and above.match(lines[i - 1]):
            i -= 1
        marks[k] = (i, name)
    if not marks:
        return [block("code", text.rstrip(), (), 1, max(1, len(lines)), "unlocated:no key positions", lang)] if text.strip() else []
    spans = ([(0, marks[0][0], "")] if marks[0][0] else []) + [(a, b, name) for (a, name), b in zip(marks, [*[m[0] for m in marks[1:]], len(lines)], strict=True)]
    out = []
    for a, b, name in spans:
        for s in range(a, b, LINES):
            part = lines[s : min(b, s + LINES)]
            while part and not part[-1].strip():
                part.pop()
            if any(p.strip() for p in part):
                out.append(block("code", "\n".join(part), [name] if name else [], s + 1, s + len(part), lang=lang))
    return out


def source_python(raw: bytes) -> list[dict]:
    """Top-level definitions with the comments above them; the rest in runs of lines."""
    text = decoded(raw)
    lines = text.splitlines()
    spans = []
    for node in ast.parse(text).body:
        start = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        while start > 1 and lines[start - 2].lstrip().startswith("#"):
            start -= 1
        spans.append((start, node.end_lineno, getattr(node, "name", "")))
    merged: list[list] = []
    for a, b, name in spans:
        if merged and not name and not merged[-1][2] and b - merged[-1][0] < LINES:
            merged[-1][1] = b
        else:
            merged.append([a, b, name])
    return [block("code", "\n".join(lines[s - 1 : min(b, s + LINES - 1)]), [name] if name else [], s, min(b, s + LINES - 1), lang="python") for a, b, name in merged for s in range(a, b + 1, LINES)]


#: How a definition begins at the left margin, by language (the languages' own syntax).
DEFINITIONS = {
    "javascript": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "typescript": r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|enum|type|namespace|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "java": r"(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|interface|enum|record|@interface)\s+(\w+)",
    "kotlin": r"(?:(?:public|private|internal|open|abstract|sealed|data|inline|suspend)\s+)*(?:class|interface|object|fun|val|var|typealias)\s+(?:<[^>]*>\s*)?([\w.]+)",
    "scala": r"(?:(?:private|protected|final|sealed|abstract|implicit|case)\s+)*(?:class|trait|object|def|val|type|enum)\s+(\w+)",
    "csharp": r"(?:(?:public|private|internal|protected|static|abstract|sealed|partial)\s+)*(?:class|interface|struct|enum|record|namespace|delegate)\s+([\w.]+)",
    "c": r"(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)|(?!return|else|typedef)[A-Za-z_][\w\s*]*?[\s*](\w+)\s*\([^;]*$",
    "c++": r"(?:template\s*<.*>\s*)?(?:class|struct|enum(?:\s+class)?|union|namespace)\s+(\w+)|(?!return|else|using|typedef)[A-Za-z_][\w\s*&:<>,]*?[\s*&](~?[\w:]+)\s*\([^;]*$",
    "go": r"func\s+(?:\([^)]*\)\s*)?(\w+)|(?:type|var|const)\s+(\w+)",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+(?=fn)|extern\s+\S+\s+)*(?:fn|struct|enum|trait|mod|type|static|const|union|macro_rules!)\s+(\w+)|impl(?:<[^>]*>)?\s+([\w:<>' ]+?)\s*(?:where\b|\{|$)",
    "swift": r"(?:(?:public|private|internal|open|final|fileprivate)\s+)*(?:class|struct|enum|protocol|extension|actor|func|let|var)\s+(\w+)",
    "ruby": r"(?:class|module|def)\s+([\w.:?!]+)",
    "php": r"(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum|function|namespace)\s+([\w\\\\]+)",
    "perl": r"(?:sub|package)\s+([\w:]+)",
    "lua": r"(?:local\s+)?function\s+([\w.:]+)",
    "shell": r"(?:function\s+)?([\w-]+)\s*\(\)\s*\{?|function\s+([\w-]+)",
    "sql": r"(?i:create)\s+(?i:or\s+replace\s+)?(?i:temp(?:orary)?\s+|unique\s+|materialized\s+)?(?i:table|view|index|function|procedure|trigger|type|schema|sequence)\s+(?i:if\s+not\s+exists\s+)?([\w.\"]+)",
    "r": r"([\w.]+)\s*(?:<-|=)\s*function\b",
    "julia": r"(?:mutable\s+)?(?:function|struct|module|macro|abstract\s+type)\s+([\w.!]+)",
    "haskell": r"(?:data|newtype|class|instance|module|type)\s+([\w.]+)|(\w+)\s*::",
    "elixir": r"(?:defmodule|def|defp|defmacro|defprotocol)\s+([\w.?!]+)",
    "erlang": r"([a-z]\w*)\s*\(.*\)\s*(?:when\b.*)?->",
    "dart": r"(?:abstract\s+)?(?:class|mixin|enum|extension|typedef)\s+(\w+)|(?!return|else|import)[A-Za-z_][\w<>?, ]*\s(\w+)\s*\([^;]*\{",
    "css": r"([.#@:\w][^{};]*?)\s*\{",
}
COMMENT = re.compile(r"\s*(?://|/\*|\*|#(?!include|define|if|endif)|--|%|;;)")


def source_of(lang: str) -> Callable[[bytes], list[dict]]:
    """A parser of one language: top-level definitions with the comments above them, the rest in runs of lines."""
    mark = re.compile(rf"^(?:{DEFINITIONS[lang]})")

    def source(raw: bytes) -> list[dict]:
        if not probably_text(raw):
            raise Declined("not text")
        return _marked(decoded(raw), mark, lang, COMMENT)

    source.__name__ = f"source_{re.sub('[^a-z]', '', lang)}"
    return source


def source_lines(raw: bytes) -> list[dict]:
    """Source in other languages: runs of lines, cut at blank ones."""
    return [b | {"kind": "code"} for b in plaintext(raw)]


def diagram_of(lang: str) -> Callable[[bytes], list[dict]]:
    """A diagram's source is one block, as its statements belong together."""

    def diagram(raw: bytes) -> list[dict]:
        if not probably_text(raw):
            raise Declined("not text")
        text = decoded(raw).strip()
        return [block("code", text, (), 1, len(text.splitlines()), lang=lang)] if text else []

    return diagram


#: Parsers by media type; the first that takes the bytes and finds text wins, plain text ends every chain.
CHAINS: dict[str, tuple[Callable[[bytes], list[dict]], ...]] = {
    "text/plain": (plaintext,),
    "text/markdown": (markdown, plaintext),
    "text/mdx": (markdown, plaintext),
    "text/html": (html,),
    "application/xhtml+xml": (html,),
    "text/csv": (spreadsheet_csv, plaintext),
    "text/tab-separated-values": (spreadsheet_csv, plaintext),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": (spreadsheet_xlsx,),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": (word,),
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": (slides,),
    "application/x-ipynb+json": (notebook, structured_json),
    "message/rfc822": (mail,),
    "application/json": (structured_json, plaintext),
    "application/toml": (structured_toml, plaintext),
    "application/yaml": (structured_yaml, plaintext),
    "text/x-python": (source_python, source_lines),
    **{f"text/{'' if lang in ('javascript', 'css') else 'x-'}{lang if lang != 'shell' else 'shellscript'}": (source_of(lang), source_lines) for lang in DEFINITIONS if lang != "sql"},
    "application/sql": (source_of("sql"), source_lines),
    "text/vnd.graphviz": (diagram_of("dot"),),
    "text/vnd.mermaid": (diagram_of("mermaid"),),
    "text/x-source": (source_lines,),
}


def _vendor() -> dict[str, tuple[Callable[[bytes], list[dict]], ...]]:
    """Chains of the bodies that ``vendor`` reads, which itself builds on this module."""
    from folioforge.operators import vendor

    return {"application/pdf": (vendor.pdf,), "application/vnd.wiki.storage+xml": (vendor.storage_format, html), "application/vnd.document-nodes+json": (vendor.document_nodes, structured_json)}


def parse(raw: bytes, media_type: str) -> tuple[list[dict], str, str]:
    """Blocks, status and detail of one document."""
    chain = CHAINS.get(media_type) or _vendor().get(media_type, ())
    if not chain:
        return [], "unsupported_media_type", f"no parser for {media_type}"
    said, declined = [], 0
    for parser in chain:
        try:
            found = parser(raw)
        except Declined as e:
            declined += 1
            said.append(f"{parser.__name__}: {e}")
        except Exception as e:  # a document's own fault stays with its row
            said.append(f"{parser.__name__}: {type(e).__name__}: {e}"[:500])
        else:
            if any(b["text"].strip() for b in found):
                return found, "parsed", ""
    if said and declined < len(said):
        return [], "failed", "; ".join(said)
    if declined == len(chain):
        return [], "unsupported_media_type", "; ".join(said)
    return [], "no_extractable_text", ""


def parsed(raw: DataFrame) -> DataFrame:
    """``document_id, blocks, status, detail`` of ``document_id, content, media_type``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [parse(c if isinstance(c, bytes) else bytes(c or b""), m) for c, m in zip(f["content"], f["media_type"], strict=True)]
            yield pd.DataFrame({"document_id": f["document_id"], "blocks": [d[0] for d in done], "status": [d[1] for d in done], "detail": [d[2] for d in done]})

    kind = raw.schema["document_id"].dataType.simpleString()
    return raw.select("document_id", "content", "media_type").mapInPandas(run, f"document_id {kind}, blocks {BLOCKS}, status string, detail string")


def resolved(anchor: str, raw: bytes) -> str | None:
    """What a line anchor points at."""
    m = re.fullmatch(r"line:(\d+)-(\d+)", anchor)
    return "\n".join(decoded(raw).splitlines()[int(m[1]) - 1 : int(m[2])]) if m else None


MOST_MEMBERS, MOST_DEPTH, MOST_BYTES = 1000, 3, 64 << 20


def members(raw: bytes, depth: int = 0, above: tuple[str, ...] = ()) -> list[tuple[str, bytes, str]]:
    """Files of a zip archive, nested ones too, as ``path, content, refused``; a refusal is a row."""
    own = hashlib.sha256(raw).hexdigest()
    if own in above:
        return [("", b"", "cycle")]
    if depth > MOST_DEPTH:
        return [("", b"", "depth")]
    out: list[tuple[str, bytes, str]] = []
    used: dict[str, int] = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for n, info in enumerate(i for i in z.infolist() if not i.is_dir()):
            path = info.filename.replace("\\", "/")
            used[path] = used.get(path, 0) + 1
            shown = path if used[path] == 1 else f"{path}#{used[path]}"
            if n >= MOST_MEMBERS:
                out.append(("", b"", "members"))
                break
            if path.startswith("/") or ".." in path.split("/"):
                out.append((shown, b"", "path"))
            elif info.flag_bits & 1:
                out.append((shown, b"", "encrypted"))
            elif (info.external_attr >> 16) & 0o170000 == 0o120000:
                out.append((shown, b"", "symlink"))
            elif info.file_size > MOST_BYTES:
                out.append((shown, b"", "size"))
            else:
                data = z.read(info)
                if path.lower().endswith(".zip"):
                    out += [(f"{shown}!{p}", c, r) for p, c, r in members(data, depth + 1, (*above, own))]
                else:
                    out.append((shown, data, ""))
    return out


#: Members that leave a task together: a frame of its own for each archive costs more than reading it.
FRAME_ROWS, FRAME_BYTES = 4096, 16 << 20


def expanded(archives: DataFrame) -> DataFrame:
    """One row per member of ``document_id, content`` archives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame_of = lambda rows: pd.DataFrame(rows, columns=["document_id", "path", "content", "refused"])
        rows: list[tuple] = []
        held = 0
        for f in frames:
            for d, c in zip(f["document_id"], f["content"], strict=True):
                try:
                    found = members(bytes(c))
                except zipfile.BadZipFile:
                    found = [("", b"", "not an archive")]
                rows += [(d, path, content, refused or None) for path, content, refused in found]
                held += sum(len(content) for _, content, _ in found)
                if len(rows) >= FRAME_ROWS or held >= FRAME_BYTES:
                    yield frame_of(rows)
                    rows, held = [], 0
        if rows:
            yield frame_of(rows)

    kind = archives.schema["document_id"].dataType.simpleString()
    return archives.select("document_id", "content").mapInPandas(run, f"document_id {kind}, path string, content binary, refused string")


def blocks(parsed_rows: DataFrame) -> DataFrame:
    """One row per block, in order."""
    return parsed_rows.select("document_id", F.posexplode("blocks").alias("position", "b")).select("document_id", "position", "b.*")
