"""Bodies of wiki products and diagrams: storage format, document nodes, graph sources, and plain PDF text.

Each parser gives the same blocks as those of ``parsing``. Diagram sources stay as they are; what
is embedded of them is rewritten as statements, so that a search by words finds them.
"""

from __future__ import annotations

import html as entities
import json
import re
import xml.etree.ElementTree as ET
import zlib

from folioforge.operators.parsing import Declined, Headings, block, decoded, slug

# --- storage format ----------------------------------------------------------------------

#: Macros whose body is set apart, and those that hold a source (fixed values of the format).
PANELS = ("info", "note", "warning", "tip", "panel", "expand", "excerpt")
SOURCES = {"code": None, "noformat": None, "graphviz": "dot", "mermaid": "mermaid", "plantuml": "plantuml"}
CHARACTER_NAMES = frozenset("amp lt gt quot apos".split())


def _text(e: ET.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def _anchor(heads: Headings) -> str:
    return f"heading:{slug(heads.path[-1]) if heads.path else ''}"


def storage_format(raw: bytes) -> list[dict]:
    """Headings, prose, lists, tables with their header rows, panels, sources, and the titles of linked pages."""
    text = re.sub(r"&(\w+);", lambda m: m[0] if m[1] in CHARACTER_NAMES else entities.unescape(m[0]), decoded(raw))
    try:
        root = ET.fromstring(f'<body xmlns:ac="urn:ac" xmlns:ri="urn:ri">{text}</body>')
    except ET.ParseError as e:
        raise Declined(f"no storage format: {e}") from e
    for e in root.iter():
        e.tag = e.tag.replace("{urn:ac}", "ac:").replace("{urn:ri}", "ri:")
        e.attrib = {k.replace("{urn:ac}", "ac:").replace("{urn:ri}", "ri:"): v for k, v in e.attrib.items()}
    heads, out = Headings(), []
    for link in root.iter("ac:link"):
        page = next((p.get("ri:content-title") for p in link.iter("ri:page")), None)
        if page and not _text(link):
            link.text = page

    def walk(parent: ET.Element) -> None:
        for e in parent:
            if re.fullmatch("h[1-6]", e.tag):
                if title := _text(e):
                    out.append(block("heading", title, heads.enter(int(e.tag[1]), title), anchor=f"heading:{slug(title, heads.slugs)}"))
            elif e.tag == "ac:structured-macro":
                name = e.get("ac:name", "")
                if name in SOURCES:
                    lang = SOURCES[name] or next((p.text for p in e.iter("ac:parameter") if p.get("ac:name") == "language"), None)
                    source = "".join(b.text or "" for b in e.iter("ac:plain-text-body")).strip("\n")
                    if source.strip():
                        out.append(block("code", source, heads.path, anchor=_anchor(heads), lang=lang))
                elif name in PANELS:
                    body = " ".join(_text(b) for b in e.iter("ac:rich-text-body"))
                    if body.strip():
                        out.append(block("panel", body.strip(), heads.path, anchor=_anchor(heads)))
                else:
                    for b in e.iter("ac:rich-text-body"):
                        walk(b)
            elif e.tag in ("ul", "ol"):
                items = [f"{f'{n}.' if e.tag == 'ol' else '-'} {_text(i)}" for n, i in enumerate(e.findall("li"), 1) if _text(i)]
                if items:
                    out.append(block("list", "\n".join(items), heads.path, anchor=_anchor(heads)))
            elif e.tag == "table":
                rows = [[_text(c) for c in r if c.tag in ("td", "th")] for r in e.iter("tr")]
                head = 0
                for r in e.iter("tr"):
                    if not len(r) or any(c.tag != "th" for c in r):
                        break
                    head += 1
                if any(any(r) for r in rows):
                    out.append(block("table", "\n".join(" | ".join(r) for r in rows), heads.path, anchor="unlocated:table", header_rows=head))
            elif e.tag in ("div", "ac:layout", "ac:layout-section", "ac:layout-cell", "ac:rich-text-body", "section"):
                walk(e)
            elif said := _text(e):
                out.append(block("prose", said, heads.path, anchor=_anchor(heads)))

    walk(root)
    return out


# --- document nodes ----------------------------------------------------------------------


def document_nodes(raw: bytes) -> list[dict]:
    """A document as JSON nodes (``type: doc``): the same blocks as of the storage format."""
    doc = json.loads(decoded(raw))
    if not isinstance(doc, dict) or doc.get("type") != "doc":
        raise Declined("no document of nodes")
    heads, out = Headings(), []

    def text_of(node: dict) -> str:
        kind, attrs = node.get("type"), node.get("attrs") or {}
        if kind == "text":
            return node.get("text", "")
        if kind == "hardBreak":
            return "\n"
        if kind in ("mention", "emoji", "status", "date"):
            return str(attrs.get("text") or attrs.get("shortName") or attrs.get("timestamp") or "")
        if kind in ("inlineCard", "blockCard", "embedCard"):
            return str(attrs.get("url") or "")
        inner = [text_of(n) for n in node.get("content") or []]
        return ("\n" if kind in ("listItem", "tableCell", "tableHeader", "panel", "blockquote") else "").join(inner)

    def walk(nodes: list[dict]) -> None:
        for n in nodes:
            kind, attrs = n.get("type"), n.get("attrs") or {}
            said = text_of(n).strip()
            if kind == "heading" and said:
                out.append(block("heading", said, heads.enter(int(attrs.get("level", 1)), said), anchor=f"heading:{slug(said, heads.slugs)}"))
            elif kind in ("bulletList", "orderedList"):
                items = [" ".join(text_of(i).split()) for i in n.get("content") or []]
                lines = [f"{f'{k}.' if kind == 'orderedList' else '-'} {t}" for k, t in enumerate(items, int(attrs.get("order", 1) or 1)) if t]
                if lines:
                    out.append(block("list", "\n".join(lines), heads.path, anchor=_anchor(heads)))
            elif kind == "codeBlock" and said:
                out.append(block("code", text_of(n), heads.path, anchor=_anchor(heads), lang=attrs.get("language")))
            elif kind == "panel" and said:
                out.append(block("panel", said, heads.path, anchor=_anchor(heads)))
            elif kind == "table":
                rows = [[" ".join(text_of(c).split()) for c in r.get("content") or []] for r in n.get("content") or []]
                head = 0
                for r in n.get("content") or []:
                    if not r.get("content") or any(c.get("type") != "tableHeader" for c in r["content"]):
                        break
                    head += 1
                if any(any(r) for r in rows):
                    out.append(block("table", "\n".join(" | ".join(r) for r in rows), heads.path, anchor="unlocated:table", header_rows=head))
            elif kind in ("layoutSection", "layoutColumn", "expand", "nestedExpand", "bodiedExtension"):
                walk(n.get("content") or [])
            elif said:
                out.append(block("prose", said, heads.path, anchor=_anchor(heads)))

    walk(doc.get("content") or [])
    return out


# --- diagrams ----------------------------------------------------------------------------

NAME = r'(?:"(?:[^"\\]|\\.)*"|[\w.]+)'
DOT_EDGE = re.compile(rf"({NAME}(?:\s*(?:->|--)\s*{NAME})+)\s*(?:\[([^\]]*)\])?")
DOT_NODE = re.compile(rf"\s*({NAME})\s*(?:\[([^\]]*)\])?\s*")
#: What ends a statement outside quotes.
DOT_END = re.compile(r'("(?:[^"\\]|\\.)*"|\[[^\]]*\])|[;\n{}]')
DOT_GROUP = re.compile(rf"\bsubgraph\s+({NAME})?\s*\{{([^{{}}]*)\}}")
LABEL = re.compile(r'\blabel\s*=\s*("(?:[^"\\]|\\.)*"|[^,\s\]]+)')
MERMAID_NODE = r"([\w-]+?)\s*(?:\[\[?\(?\"?([^\]\)\"]*)\"?\)?\]?\]|\(\(?\"?([^\)\"]*)\"?\)?\)|\{\"?([^}\"]*)\"?\})?"
MERMAID_EDGE = re.compile(rf"^\s*{MERMAID_NODE}\s*(?:--+|==+|-\.+-?)(?:>|x|o)?\s*(?:\|([^|]*)\|)?\s*{MERMAID_NODE}\s*;?\s*$")


def _plain(name: str) -> str:
    return re.sub(r"\\n", " ", name.strip().strip('"')).strip()


def _dot(source: str) -> tuple[list[tuple[str, str, str]], dict[str, list[str]], list[str]]:
    # A comment inside quotes is none.
    body = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/|(?m:^\s*#[^\n]*)', lambda m: m[1] or "", source, flags=re.S)
    parts = DOT_END.sub(lambda m: m[1] or "\0", body).split("\0")
    alone = [m for p in parts if (m := DOT_NODE.fullmatch(p))]
    labels = {_plain(m[1]): _plain(found[1]) for m in alone if m[2] and (found := LABEL.search(m[2]))}
    shown = lambda n: labels.get(_plain(n), _plain(n))
    edges = []
    for m in DOT_EDGE.finditer(body):
        names = re.findall(NAME, re.sub(r"->|--", " ", m[1]))
        said = LABEL.search(m[2] or "")
        edges += [(shown(a), shown(b), _plain(said[1]) if said else "") for a, b in zip(names, names[1:], strict=False)]
    groups = {}
    for m in DOT_GROUP.finditer(body):
        title = LABEL.search(m[2])
        inside = [shown(n) for n in re.findall(NAME, re.sub(r"\[[^\]]*\]|\blabel\s*=[^;\n]*|->|--", " ", m[2]))]
        groups[_plain(title[1]) if title else _plain(m[1] or "group")] = list(dict.fromkeys(inside))
    skipped = {"node", "edge", "graph", "digraph", "subgraph", "strict", "label", "rankdir"}
    nodes = [shown(m[1]) for m in alone if _plain(m[1]) not in skipped]
    return edges, groups, nodes


def _mermaid(source: str) -> tuple[list[tuple[str, str, str]], dict[str, list[str]], list[str]]:
    labels: dict[str, str] = {}
    edges: list[tuple[str, str, str]] = []
    groups: dict[str, list[str]] = {}
    nodes: list[str] = []
    inside: list[str] = []
    for line in source.splitlines():
        line = re.sub(r"%%.*", "", line).strip()
        if not line or re.match(r"(?:graph|flowchart|direction|classDef|class|style|click)\b", line):
            continue
        if m := re.match(r"subgraph\s+(.*)", line):
            inside.append(_plain(re.sub(r"^\w+\s*\[(.*)\]$", r"\1", m[1])))
            groups.setdefault(inside[-1], [])
            continue
        if line == "end" and inside:
            inside.pop()
            continue
        met = []
        if m := MERMAID_EDGE.match(line):
            left, right = (m[1], m[2] or m[3] or m[4]), (m[6], m[7] or m[8] or m[9])
            edges.append((m[1], m[6], _plain(m[5] or "")))
            met = [left, right]
        elif m := re.fullmatch(rf"{MERMAID_NODE};?", line):
            met = [(m[1], m[2] or m[3] or m[4])]
        for name, said in met:
            nodes.append(name)
            if said:
                labels[name] = _plain(said)
            if inside and name not in groups[inside[-1]]:
                groups[inside[-1]].append(name)
    shown = lambda n: labels.get(n, n)
    return [(shown(a), shown(b), t) for a, b, t in edges], {g: [shown(n) for n in v] for g, v in groups.items()}, [shown(n) for n in nodes]


def statements(source: str, lang: str) -> str:
    """A diagram in statements: its edges, its groups, what no edge meets; no longer than the source itself.
    Empty if it has none."""
    if lang not in ("dot", "graphviz", "mermaid"):
        return ""
    edges, groups, nodes = _mermaid(source) if lang == "mermaid" else _dot(source)
    said = [f"{a} to {b}{f': {t}' if t else ''}" for a, b, t in dict.fromkeys(edges)]
    said += [f"{g} holds {', '.join(v)}" for g, v in groups.items() if v]
    met = {n for a, b, _ in edges for n in (a, b)}
    said += list(dict.fromkeys(n for n in nodes if n not in met))
    out = ""
    for s in said:
        longer = f"{out}\n{s}" if out else s
        if len(longer) > len(source):
            break
        out = longer
    return out


def embedded_text(kind: str, lang: str | None, text: str) -> str:
    """What is embedded of a block: a diagram's statements, else its own text."""
    return (statements(text, lang or "") or text) if kind == "code" else text


# --- PDF ---------------------------------------------------------------------------------

STREAM = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|\[(?:[^\[\]\\]|\\.)*\]\s*TJ|<[0-9A-Fa-f\s]*>|T\*|Td|TD|Tm|ET|Tj|'|\"", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}


def _literal(raw: bytes) -> str:
    if raw.startswith(b"<"):
        found = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((found + b"0" * (len(found) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def _page_text(content: bytes) -> str:
    lines: list[str] = [""]
    for m in SHOWN.finditer(content):
        t = m.group()
        if t[:1] in b"(<":
            lines[-1] += _literal(t)
        elif t[:1] == b"[":
            lines[-1] += "".join(_literal(x) for x in re.findall(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>", t))
        elif t in (b"T*", b"Td", b"TD", b"Tm", b"ET", b"'", b'"') and lines[-1].strip():
            lines.append("")
    return "\n".join(line.strip() for line in lines if line.strip())


def pdf(raw: bytes) -> list[dict]:
    """One prose block per page with text, anchored by its page.

    Reads pages whose content is plain or deflated, and text in fonts of a single-byte or Unicode coding; scans,
    encrypted files, object streams and fonts with own codings are beyond it and are declined.
    """
    if not raw.startswith(b"%PDF-"):
        raise Declined("no PDF")
    if b"/Encrypt" in raw:
        raise Declined("an encrypted PDF")
    objects = {int(m[1]): m[2] for m in STREAM.finditer(raw)}

    def content_of(number: int) -> bytes:
        body = objects.get(number, b"")
        if b"stream" not in body:
            return b"\n".join(content_of(int(n)) for n in re.findall(rb"(\d+)\s+\d+\s+R", body)) if body.strip().startswith(b"[") else b""
        head, _, data = body.partition(b"stream")
        data = data.lstrip(b"\r").removeprefix(b"\n")
        data = data[: data.rfind(b"endstream")] if b"endstream" in data else data
        if b"FlateDecode" in head:
            try:
                return zlib.decompressobj().decompress(data)
            except zlib.error:
                return b""
        return b"" if b"/Filter" in head else data

    out = []
    pages = [n for n, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    for page, number in enumerate(pages, 1):
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", objects[number])
        refs = re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m else []
        if text := _page_text(b"\n".join(content_of(int(r)) for r in refs)):
            out.append(block("prose", text, (), page, page, f"page:{page}"))
    if not out:
        raise Declined("no text that can be read without fonts")
    return out
