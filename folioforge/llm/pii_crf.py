"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers; each is scanned
in time linear in the text. The field adds what they miss: numbers written without a country
code, addresses with their marks spelled out, and, as a kind of their own after the others,
secrets such as tokens, keys and passwords. It labels tokens by their word shapes and
neighbours, is trained here on a small labelled table of marked sentences by gradient ascent
on the conditional likelihood, and is decoded by Viterbi over many windows at once in numpy.

A token starts a window if it has a digit or an at sign, or spells one ("at" or "dot" in
brackets, "dot" by itself, "at" before a dotted name), in any case. The field's kinds have no
span without such a token, which is a rule of the field: text further than ``REACH`` tokens
from any is all outside. A window grows to white space on both sides, however far it is, and
windows that touch are one, so no span is cut; the longest window bounds what a task holds, at
some hundred bytes a token.

Base spans always stay; a span of the field that overlaps one is dropped, and so is one that
breaks its kind's own rule (a phone number has 7 to 15 digits, an address has both marks, a
card passes Luhn, a secret has 8 characters, a letter and a digit at least). Positions are code
points, the end is exclusive.

Cases: null is empty; an empty text has no span; a very long text is read whole; repeated
rows, and those without an id, stay; ties of two labels go to the first in order; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import texts_of

KINDS = ("email", "ip", "card", "phone")
#: The field's kinds: those of the patterns, and what no pattern finds.
FIELD = (*KINDS, "secret")
LABELS = ("O", *(f"{b}-{k}" for k in FIELD for b in "BI"))
REACH = 8
BUCKETS = 1 << 12
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A long run of letters and digits is one token.
TOKEN = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{12,}|[^\W\d_]+|[0-9]+|[^\sA-Za-z0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[{]\s{0,2}(?:at|dot)\s{0,2}[)\]}]|\bdot\b|\bat\s{1,2}[A-Za-z-]{1,64}\.[A-Za-z]", re.IGNORECASE)
AT_MARK = re.compile(r"@|[(\[{]\s{0,2}at\s{0,2}[)\]}]|\sat\s", re.IGNORECASE)
DOT_MARK = re.compile(r"[A-Za-z0-9]\.[A-Za-z0-9]|\bdot\b", re.IGNORECASE)
SPACE = re.compile(r"\s")
ANY_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind in the order of KINDS, then by start."""
    out: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if ANY_DIGIT.search(text) is None:
        return out
    for m in DOTTED.finditer(text):
        # Of a run of numbers, each four in turn are one match.
        parts, begin = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", begin, begin + size))
            begin += size + 1
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# The labelled table: sentences with marked spans, <kind:text>. A seeded rule fills in digits, names and
# secrets (an upper-case word in braces) and puts plain words around them.
MARKED = (
    "Call <phone:(555) 201-4477> before noon.",
    "You can reach us at <phone:555-201-4477> or by mail.",
    "Phone: <phone:555.201.4477>, ask for the desk.",
    "tel <phone:0049 30 2014477> from abroad",
    "My number is <phone:555 201 4477> and I am in all day.",
    "fax <phone:(030) 201-4477> , room 12",
    "<phone:(555) 201-4477> is the night line",
    "Text me on <phone:555-201-4477>.",
    "Write to <email:anna (at) mail dot example dot com> today",
    "Write to <email:anna.b [at] mail [dot] example [dot] com> today",
    "contact <email:anna42 (at) example (dot) org> for help",
    "mail <email:anna [at] example.com> , please",
    "send it to <email:b.carl (at) example.net> now",
    "<email:carl {at} example {dot} org> answers",
    "Mail <email:anna (AT) example (DOT) org> first",
    "ask <email:carl [ at ] mail [ dot ] com> about it",
    "you find me as <email:anna at mail dot com> there",
    "my address is <email:carl.b at example.net> , as ever",
    "reach <email:anna.42@mail3.example.com> by noon",
    "the box is <email:carl@example.org> , thanks",
    "host <ip:10.2.30.4> is down",
    "from <ip:192.168.10.22> port 8080",
    "card <card:4111 1111 1111 1111> was charged",
    "pay with <card:4111111111111111> , exp 04/27",
    "call <phone:+1 (555) 201-4477> at once",
    'token = "<secret:{HEX}>"',
    'the key: "<secret:{MIXED}>" , keep it',
    "api_key=<secret:{MIXED}>",
    "secret: <secret:{HEX}> in the file",
    'password = "<secret:{PASS}>"',
    "export AUTH_TOKEN=<secret:{MIXED}>",
    "use the token <secret:{HEX}> to log in",
    "Authorization: Bearer <secret:{MIXED}>",
    "pwd=<secret:{PASS}> ; user=anna",
    "access key <secret:{UPPER}> was found",
    '"secret": "<secret:{HEX}>",',
    "<phone:555.201.4477> is open all week",
    "the desk has <phone:555.201.4477>",
    "line <phone:555 201 4477> , ask for anna",
    "the mobile of carl: <phone:555 201 4477>",
    "<phone:0049 30 2014477>",
    "or dial <phone:0049 30 2014477> at night",
    "write me at <email:anna at mail dot com> .",
    "signed <email:carl at example dot org>",
    "<email:anna at mail dot com> has the list",
    "or take <email:anna.b at mail dot example dot com> for it",
    "<email:anna [ at ] example [ dot ] com> for more",
    "we read <email:carl ( at ) example ( dot ) net> daily",
    "ask <email:anna [AT] mail [DOT] org>",
    "key <secret:{MIXED}> is set",
    "the api key is <secret:{MIXED}>",
    "a new api key <secret:{HEX}> was made",
    "token: <secret:{HEX}>",
    "a token <secret:{MIXED}> was sent",
    "their token: <secret:{MIXED}> , now void",
    "bearer <secret:{MIXED}> was sent",
    "we saw bearer <secret:{HEX}> there",
    "password <secret:{PASS}> is weak",
    "auth: <secret:{HEX}>",
)
CLEAR = (
    "Version 2.0 of the licence, released in 2019.",
    "The year 1998 had 365 days and 12 months.",
    "It cost 1,299.50 in all, or 20% less than in 2021.",
    "See section 4.2.1 on page 112 (of 340).",
    "Meet at 10:30 on 2024-03-15 in room 204.",
    "hash {HEX} of the file",
    "commit {HEX} fixes it",
    "sha1 {HEX} and size 4096",
    "checksum: {HEX}",
    "build {MIXED} was shipped",
    "the id {MIXED} of row 12",
    "item 0012 of 0450, lot 77-12",
    "He is at home (at last) with 3 dogs.",
    "It was seen (at) the gate, dot by dot, in 1980.",
    "a dot on the map and a line at the edge",
    "between 1914-1918 and 1939-1945 it was closed",
    "ISBN 978-3-16-148410-0 is out of print",
    "order 2024-000123-77 ships on 12.05.2024",
    "order number 4417123456789113 was sent",
    "use CC BY-NC 4.0 for it",
    "the ratio 16:9 or 4:3 , at 25 fps",
    "rows 100 200 300 400 of the table",
    "sum of 12 34 56 78 is 180",
    "a @ b means matrix product",
    "see @anna for 2 tickets",
    "from 52.5200 to 13.4050 degrees",
    "score 120-98 in game 7",
    "the 1980s and the 1990s",
    "the token of thanks came in 2004",
    "a secret kept for 30 years, the key to room 12",
)


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def _shape(word: str) -> str:
    if len(word) >= 12 and word.isascii() and not word.isalpha() and not word.isdigit():
        return f"m{min(len(word) // 8, 5)}{'h' if not word.lower().strip('0123456789abcdef') else 'X' if word.isupper() else 'x'}"
    if word[0] in "0123456789":
        return f"d{min(len(word), 17)}"
    if len(word) == 1 and not word.isalpha():
        return word if word < "\x7f" else "?"
    return ("X" if word[0].isupper() else "x") + ("X" if word[1:].isupper() and len(word) > 1 else "x") + str(min(len(word), 3))


#: Words that tell by themselves (fixed values); all others are known by their shape alone.
TELLING = frozenset("at dot com org net call phone tel fax mail email text reach number mobile ip host card page section version room year isbn order key token secret password passwd pwd api auth bearer authorization access hash commit sha md5 checksum build id".split())


def _atoms(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """Per token its shape, whether it touches the token before, and a telling word."""
    out, end = [], -1
    for a, b in spans:
        word = text[a:b]
        low = word.lower()
        out.append(f"{_shape(word)}{'_' if a == end else ' '}{low if low in TELLING else ''}")
        end = b
    return out


#: What is joined into one feature: offsets of the tokens whose atoms it holds.
TEMPLATES = ((0,), (-1,), (1,), (-1, 0), (0, 1), (-2, -1), (1, 2), (-1, 0, 1), (-2, -1, 0), (0, 1, 2), (0, 1, 2, 3, 4), (-4, -3, -2, -1, 0))


def _features(atoms: list[str]) -> np.ndarray:
    """Feature buckets of each token."""
    n, crc = len(atoms), zlib.crc32
    padded = ["^"] * 4 + atoms + ["$"] * 4
    out = np.empty((n, len(TEMPLATES)), np.int16)
    for start in range(0, n, 1 << 14):
        end = min(n, start + (1 << 14))
        out[start:end] = [[crc(f"{j}|{'|'.join([padded[i + 4 + o] for o in t])}".encode()) % BUCKETS for j, t in enumerate(TEMPLATES)] for i in range(start, end)]
    return out


def _example(marked: str) -> tuple[str, list[Span]]:
    text, spans, at = "", [], 0
    for m in re.finditer(r"<(\w+):([^>]*)>", marked):
        text += marked[at : m.start()]
        spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
        text += m.group(2)
        at = m.end()
    return text + marked[at:], spans


#: Plain words around the sentences, and names in them.
FILLS = "the a of and house river we they old report said morning under later green paper with then two people here".split()
NAMES = "anna carl dora emil jo maria thea ben lee omar".split()


def _secret(kind: str, rng: np.random.Generator) -> str:
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabet, sizes = {"HEX": (digits + lower[:6], (16, 24, 32, 40, 64)), "MIXED": (lower + upper + digits, (16, 20, 24, 32, 40)), "UPPER": (upper + digits, (16, 20, 24)), "PASS": (lower + digits, (8, 10, 12, 18))}[kind]
    made = "".join(alphabet[i] for i in rng.integers(len(alphabet), size=rng.choice(sizes)))
    return made[:-2] + "a7" if kind != "UPPER" else made[:-2] + "A7"


def filled(templates: tuple[str, ...], copies: int, rng: np.random.Generator, names: list[str] = NAMES, fills: list[str] = FILLS) -> list[tuple[str, list[Span]]]:
    """Texts and their spans: ``copies`` of each sentence with other digits, names, secrets and neighbours."""
    out = []
    for k in range(copies):
        for s in templates:
            text = re.sub(r"[1-9]", lambda m: m.group() if k == 0 else str(rng.integers(1, 10)), s) if "<card" not in s and "<ip" not in s else s
            text = re.sub(r"\b(anna|carl)\b", lambda m: m.group() if k == 0 else names[rng.integers(len(names))], text)
            text = re.sub(r"\{([A-Z]+)\}", lambda m: _secret(m.group(1), rng), text)
            pad = lambda n: " ".join(fills[rng.integers(len(fills))] for _ in range(n))
            if k % 3:
                text = f"{pad(rng.integers(0, 5))} {text} {pad(rng.integers(0, 5))}".strip()
            out.append(_example(text))
    return out


def labelled_table(copies: int = 12, seed: int = 7) -> list[tuple[str, list[Span]]]:
    return filled((*MARKED, *CLEAR), copies, np.random.default_rng(seed))


def _tagged(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    toks = _tokens(text)
    tags = np.zeros(len(toks), np.int64)
    for kind, a, b in spans:
        inside = [i for i, (s, e) in enumerate(toks) if s >= a and e <= b]
        for j, i in enumerate(inside):
            tags[i] = LABELS.index(f"{'I' if j else 'B'}-{kind}")
    return _features(_atoms(text, toks)), tags


def _padded(rows: list[np.ndarray], fill: int = 0) -> np.ndarray:
    width = max(map(len, rows))
    out = np.full((len(rows), width, *rows[0].shape[1:]), fill, rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


#: Moves between labels that no labelling has: into a kind's inside from elsewhere.
ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])


@lru_cache(maxsize=1)
def trained(epochs: int = 60, rate: float = 0.25, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission (buckets x labels) and move weights, the same at every call.

    Forward and backward sums are scaled step by step, over sentences in order of their lengths, so
    each step is a product of small matrices over the sentences that are that long.
    """
    data = sorted((_tagged(t, s) for t, s in labelled_table()), key=lambda d: -len(d[1]))
    x, y = _padded([f for f, _ in data]), _padded([t for _, t in data])
    lengths = np.array([len(t) for _, t in data])
    n, width, labels = len(data), x.shape[1], len(LABELS)
    long = [int((lengths > t).sum()) for t in range(width)]
    live = np.arange(width)[None, :] < lengths[:, None]
    emit, move = np.zeros((BUCKETS, labels)), np.zeros((labels, labels))
    g_emit, g_move = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    begin = np.array([not name.startswith("I-") for name in LABELS], np.float64)
    gold = np.zeros((n, width, labels))
    np.put_along_axis(gold, y[:, :, None], 1.0, 2)
    gold *= live[:, :, None]
    gold_move = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    tokens = x[live].reshape(-1)
    order = np.argsort(tokens, kind="stable")
    used, first = np.unique(tokens[order], return_index=True)
    of_token = order // x.shape[2]
    for _ in range(epochs):
        score = emit[x].sum(2)
        score = np.exp(score - score.max(2, keepdims=True))
        steps = np.where(ALLOWED, np.exp(move), 0.0)
        alpha, beta = np.zeros_like(score), np.ones_like(score)
        ahead = np.zeros_like(score)  # of a token and all after it, divided as alpha is
        for t in range(width):
            k = long[t]
            here = score[:k, t] * (alpha[:k, t - 1] @ steps if t else begin)
            alpha[:k, t] = here / here.sum(1, keepdims=True)
        for t in range(width - 1, 0, -1):
            k = long[t]
            after = score[:k, t] * beta[:k, t]
            before = after @ steps.T
            scale = (alpha[:k, t - 1] * before).sum(1, keepdims=True)
            ahead[:k, t], beta[:k, t - 1] = after / scale, before / scale
        node = alpha * beta
        node *= live[:, :, None] / np.maximum(node.sum(2, keepdims=True), 1e-300)
        edge = steps * sum(alpha[: long[t], t - 1].T @ ahead[: long[t], t] for t in range(1, width))
        d_move = gold_move - edge - decay * n * move
        d_emit = -decay * n * emit
        d_emit[used] += np.add.reduceat((gold - node)[live][of_token], first)
        g_emit += d_emit**2
        g_move += d_move**2
        emit += rate * d_emit / np.sqrt(g_emit)
        move += rate * d_move / np.sqrt(g_move)
    return emit, move


def viterbi(rows: list[np.ndarray], emit: np.ndarray, move: np.ndarray) -> list[np.ndarray]:
    """The best labels of each window; ``rows`` has their tokens' feature buckets."""
    if not rows:
        return []
    x, lengths = _padded(rows), np.array([len(r) for r in rows])
    score = np.zeros((*x.shape[:2], len(LABELS)))
    for j in range(x.shape[2]):
        score += emit[x[:, :, j]]
    steps = move + np.where(ALLOWED, 0.0, -1e4)
    best = score[:, 0] + np.array([-1e4 if name.startswith("I-") else 0.0 for name in LABELS])
    back = np.zeros((x.shape[1], len(rows), len(LABELS)), np.int8)
    for t in range(1, x.shape[1]):
        via = best[:, :, None] + steps
        back[t] = via.argmax(1)
        best = np.where((t < lengths)[:, None], via.max(1) + score[:, t], best)
    out = np.zeros((len(rows), x.shape[1]), np.int64)
    now = best.argmax(1)
    for t in range(x.shape[1] - 1, -1, -1):
        now = np.where(t == lengths - 1, best.argmax(1), now)
        out[:, t] = now
        now = np.where(t < lengths, back[t][np.arange(len(rows)), now], now) if t else now
    return [o[:n] for o, n in zip(out, lengths.tolist(), strict=True)]


def _windows(text: str) -> list[list[tuple[int, int]]]:
    """Tokens of each stretch of text around triggers."""
    out: list[list[tuple[int, int]]] = []
    reach = REACH * 12
    ranges: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        at, end = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if ranges and at <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([at, end])
    end = 0
    for a, b in ranges:
        # Whole tokens only: the stretch grows to white space on both sides, up to the one before it.
        if b <= end:
            continue
        a = max(a, end)
        while a > end and not text[a - 1].isspace():
            a -= 1
        m = SPACE.search(text, b)
        b = m.start() if m else len(text)
        toks = [(s + a, e + a) for s, e in _tokens(text[a:b])]
        if toks and out and a == end:
            out[-1] += toks
        elif toks:
            out.append(toks)
        end = b
    return out


def _good(kind: str, text: str) -> bool:
    d = digits_of(text)
    if kind == "phone":
        return 7 <= len(d) <= 15 and not re.search(r"[A-Za-z]", text) and bool(re.search(r"[\x20().-]", text))
    if kind == "email":
        return bool(AT_MARK.search(text)) and bool(DOT_MARK.search(text)) and text[0].isalnum() and (text[-1].isalnum() or text[-1] in ")]}")
    if kind == "secret":
        return len(text) >= 8 and bool(d) and bool(re.search(r"[A-Za-z]", text)) and not SPACE.search(text)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return len(text.split(".")) == 4 and all(p.isdigit() and int(p) <= 255 for p in text.split("."))


def spans_of(texts: list[str], emit: np.ndarray, move: np.ndarray, every: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and all spans, both by kind and start; with ``every``, each text is one window."""
    base = [base_spans(t) for t in texts]
    owners, toks, rows = [], [], []
    for i, t in enumerate(texts):
        for w in [_tokens(t)] if every else _windows(t):
            if not w:
                continue
            owners.append(i)
            toks.append(w)
            rows.append(_features(_atoms(t, w)))
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    labels: dict[int, np.ndarray] = {}
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and end - start < 1024 and len(rows[order[end]]) * (end - start) < 100_000:
            end += 1
        part = order[start:end]
        labels.update(zip(part, viterbi([rows[i] for i in part], emit, move), strict=True))
        start = end
    added: list[list[Span]] = [[] for _ in texts]
    for i, owner in enumerate(owners):
        tags, w, text = labels[i], toks[i], texts[owner]
        j = 0
        while j < len(tags):
            name = LABELS[tags[j]]
            if name == "O":
                j += 1
                continue
            k = j + 1
            while k < len(tags) and LABELS[tags[k]] == f"I-{name[2:]}":
                k += 1
            a, b = w[j][0], w[k - 1][1]
            if _good(name[2:], text[a:b]) and (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()) and all(b <= s or a >= e for _, s, e in base[owner]):
                added[owner].append((name[2:], a, b))
            j = k
    key = lambda s: (FIELD.index(s[0]), s[1], s[2])
    return [(b, sorted(b + a, key=key)) for b, a in zip(base, added, strict=True)]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = 256) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())  # BUCKETS x labels numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, move = weights.value
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                rows = spans_of(texts_of(batch.column(1)), emit, move)
                counts = [[sum(s[0] == k for s in b) for b, _ in rows] for k in KINDS]
                shas = [hashlib.sha256(shown(b).encode()).hexdigest() for b, _ in rows]
                yield pa.record_batch([batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array([shown(s) for _, s in rows], pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
