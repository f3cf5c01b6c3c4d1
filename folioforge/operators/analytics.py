"""Text analytics around answers: glossary detection and lookup, redaction, citation markers."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import acronym_key, acronym_shaped, initials

# --- glossary ----------------------------------------------------------------------------

#: What each form of a definition is worth (fixed values).
FORMS = {"parenthetical": 0.55, "term_first": 0.55, "dash": 0.45, "colon": 0.45, "table": 0.40, "list": 0.35}
INITIALS, CONTEXT, LEAST = 0.35, 0.15, 0.60
CONTEXT_WORDS = frozenset("glossary acronyms acronym abbreviations abbreviation definitions definition terms terminology".split())
SKIPPED = frozenset("a an and at by for from in of on or the to with".split())
TERM = r"[A-Z][A-Za-z0-9&/-]{1,11}"
PHRASE = r"[A-Za-z][A-Za-z0-9'’&/ -]{3,80}"
FORM_RES = (
    ("parenthetical", re.compile(rf"({PHRASE}?)\s+\(({TERM})\)"), (2, 1)),
    ("term_first", re.compile(rf"\b({TERM})\s+\(({PHRASE})\)"), (1, 2)),
    ("table", re.compile(rf"^\s*\|?\s*({TERM})\s*\|\s*({PHRASE}?)\s*(?:\||$)"), (1, 2)),
    ("dash", re.compile(rf"^\s*({TERM})\s+[—–-]\s+({PHRASE})"), (1, 2)),
    ("colon", re.compile(rf"^\s*({TERM}):\s+({PHRASE})"), (1, 2)),
)
ENTRY = "array<struct<acronym:string,expansion:string,form:string,confidence:double,line:int>>"


def shaped(term: str) -> bool:
    caps = sum(c.isupper() for c in term)
    alpha = sum(c.isalpha() for c in term)
    return alpha >= 2 and term[0].isupper() and caps >= 0.6 * alpha


def initials_forms(text: str) -> set[str]:
    """Initials with and without function words, camel-cased words split or not."""
    out = set()
    for split in (False, True):
        t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text) if split else text
        words = re.findall(r"[A-Za-z0-9]+", t)
        out.add("".join(w[0] for w in words).upper())
        out.add("".join(w[0] for w in words if w.lower() not in SKIPPED).upper())
    return out


def core(expansion: str, acronym: str) -> str:
    """The last words of a phrase whose initials are the acronym; the whole phrase if there are none."""
    words = expansion.strip(" -–—,;:.").split()
    for start in range(len(words) - 1, -1, -1):
        if words[start].lower() not in SKIPPED and acronym.upper() in initials_forms(" ".join(words[start:])):
            return " ".join(words[start:])
    return " ".join(words)


def detect(text: str, in_context: bool = False) -> list[dict]:
    """Definitions in a chunk, the best per acronym and expansion, those of ``LEAST`` at least."""
    best: dict[tuple[str, str], dict] = {}
    before = ""
    for n, line in enumerate(text.split("\n"), 1):
        bare = re.sub(r"^\s*(?:[-*+•]|\d+[.)])\s+", "", line)
        found = [(form, m.group(a), m.group(b)) for form, pattern, (a, b) in FORM_RES for m in pattern.finditer(bare)]
        if before and (m := re.match(r"^\s*:\s+(.+)$", line)) and re.fullmatch(TERM, before.strip()):
            found.append(("list", before.strip(), m[1]))
        before = line
        for form, term, phrase in found:
            if not shaped(term):
                continue
            acronym = re.sub(r"[^A-Z0-9]", "", term.upper())
            expansion = core(phrase, acronym)
            if not expansion or expansion.upper() == acronym:
                continue
            score = FORMS[form] + (INITIALS if acronym in initials_forms(expansion) else 0.0) + (CONTEXT if in_context else 0.0)
            entry = {"acronym": acronym, "expansion": expansion, "form": form, "confidence": round(min(1.0, score), 4), "line": n}
            key = (acronym, expansion.casefold())
            if entry["confidence"] >= LEAST and (key not in best or entry["confidence"] > best[key]["confidence"]):
                best[key] = entry
    return sorted(best.values(), key=lambda e: (e["acronym"], -e["confidence"], e["expansion"]))


def glossary(chunks: DataFrame) -> DataFrame:
    """``chunk_id, acronym, expansion, form, confidence, line`` of ``chunk_id, text, heading_text``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [detect(t or "", bool(CONTEXT_WORDS & set(re.findall(r"[a-z]+", (h or "").lower())))) for t, h in zip(f["text"], f["heading_text"], strict=True)]
            yield pd.DataFrame({"chunk_id": f["chunk_id"], "e": found})

    rows = chunks.select("chunk_id", "text", "heading_text").mapInPandas(run, f"chunk_id string, e {ENTRY}")
    entries = rows.select("chunk_id", F.explode("e").alias("e")).select("chunk_id", "e.*")
    return entries.unionByName(headed(chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text", "heading_text"))).where(refusal(F.col("acronym"), F.col("expansion"), F.col("form")).isNull())


#: Words that no expansion begins with (fixed values): circumstances, and words that point instead of naming.
NO_OPENING = ("after", "although", "because", "before", "if", "once", "since", "though", "unless", "until", "when", "whenever", "whether", "while", "he", "it", "she", "that", "these", "they", "this", "those", "we", "you", "there")
#: Words of an expansion at most; longer ones are about a term.
MOST_WORDS = 10


def spelled(acronym: Column, phrase: Column) -> Column:
    """Whether the initials of a phrase's words, with or without function words, are the acronym."""
    return (initials(phrase, False) == acronym) | (initials(phrase, True) == acronym)


def refusal(acronym: Column, expansion: Column, form: Column) -> Column:
    """Why an entry is no definition, null if it is one: too long, of several sentences, a heading over prose that doesn't
    spell it, or prose by its first word. Initials that agree outrank the first word; an acronym is no such word."""
    words = F.split(F.trim(expansion), r"\s+")
    first = F.regexp_extract(expansion, r"^[^\w]*([\w'’]+)", 1)
    proved = spelled(acronym, expansion)
    return (
        F.when((F.trim(expansion) == "") | (F.size(words) > MOST_WORDS), "too_long")
        .when(F.rlike(expansion, F.lit(r"[.!?]\s")), "several_sentences")
        .when((form == "heading") & ~proved, "unproved_heading")
        .when(~proved & F.lower(first).isin(*NO_OPENING) & ~acronym_shaped(first), "refused_opening")
    )


def headed(chunks: DataFrame) -> DataFrame:
    """Headings that are acronyms, with the line below them: ``chunk_id, acronym, expansion, form, confidence, line``.

    Where the line goes on with a description, the part before it is the expansion if its initials are the acronym.
    """
    acronym = acronym_key(F.trim(F.regexp_extract("heading_text", "([^>]*)$", 1)))
    line = F.trim(F.regexp_replace(F.split("text", "\\n")[0], r"[\s.!?]+$", ""))
    rows = chunks.select("chunk_id", acronym.alias("acronym"), line.alias("line_")).where("acronym is not null and line_ <> ''")
    head = F.trim(F.regexp_extract("line_", r"^([^,;:.–—]*)", 1))
    expansion = F.when(spelled(F.col("acronym"), F.col("line_")), F.col("line_")).when(spelled(F.col("acronym"), head), head).otherwise(F.col("line_"))
    return rows.select("chunk_id", "acronym", expansion.alias("expansion"), F.lit("heading").alias("form"), F.lit(FORMS["dash"] + INITIALS).alias("confidence"), F.lit(1).alias("line"))


def parenthetical(text: Column) -> Column:
    """Acronyms that follow their words in brackets, all in expressions: the form that SQL can check."""
    return F.regexp_extract_all(text, F.lit(r"\(([A-Z][A-Z0-9]{1,11})\)"), F.lit(1))


def lookups(entries: DataFrame, aliases: DataFrame, keys: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries of live documents whose acronym or alias is asked for: ``query_id, entry_id, acronym, expansion, confidence``."""
    named = entries.select("entry_id", F.col("acronym").alias("key")).union(aliases.select("entry_id", "key")).distinct()
    hit = keys.join(named, "key").select("query_id", "entry_id").distinct()
    live = entries.join(documents.select("document_id"), "document_id", "left_semi")
    return hit.join(live, "entry_id").select("query_id", "entry_id", "acronym", "expansion", "confidence")


def surfaces(queries: DataFrame) -> DataFrame:
    """``query_id, key, surface``: what a query's tokens could stand for, the first surface of each key."""
    tok = F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_&/.'’-]+"), F.lit(0))).alias("at", "surface")
    rows = queries.select("query_id", tok).withColumn("key", acronym_key(F.col("surface"))).where("key is not null")
    return rows.groupBy("query_id", "key").agg(F.min_by("surface", "at").alias("surface"))


#: Phrases that ask for a meaning; %s is the term (fixed values).
FRAMES = (r"what (?:is|are|does) (?:an? |the )?%s\b", r"what's (?:an? |the )?%s\b", r"define %s\b", r"definition of %s\b", r"meaning of %s\b", r"%s (?:stands for|means|meaning)\b", r"expand %s\b", r"who or what is %s\b")


def fires(surface: Column, key: Column, text: Column, common: tuple[str, ...]) -> Column:
    """Why a surface is taken for its key: exact case, a definitional frame, or no common word; null if not."""
    escaped = F.regexp_replace(F.lower(surface), r"([.+*?^$()\[\]{}|\\/-])", r"\\$1")
    framed = F.lit(False)
    for f in FRAMES:
        before, after = f.split("%s")
        framed = framed | F.rlike(F.lower(text), F.concat(F.lit(before), escaped, F.lit(after)))
    return F.when(surface == key, "exact_case").when(framed, "definitional_frame").when(~F.lower(surface).isin(*common), "unambiguous")


def conflicts(entries: DataFrame, least: float = 0.6) -> DataFrame:
    """Per acronym its best expansion, and whether it has several: those are never resolved."""
    normal = F.lower(F.trim(F.regexp_replace("expansion", r"[\s\-]+", " ")))
    good = entries.where(F.col("confidence") >= least).withColumn("n", normal)
    return good.groupBy("acronym").agg(F.count_distinct("n").alias("n_expansions"), F.min_by("expansion", F.struct(-F.col("confidence"), "expansion")).alias("best")).withColumn("conflict", F.col("n_expansions") > 1)


def rewritten(text: Column, surface: Column, expansion: Column) -> Column:
    """The first occurrence of the surface replaced."""
    at = F.locate(surface, text) if isinstance(surface, str) else F.instr(text, surface)
    return F.when(at > 0, F.overlay(text, expansion, at, F.length(surface))).otherwise(text)


# --- redaction ---------------------------------------------------------------------------

DETECTORS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![\w-])",
    "phone": r"(?<![\w+])\+?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?(?:\(\d{1,4}\)|\d{2,4})){2,5}(?!\w)",
    "credit-card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ipv6-address": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])",
    "ip-address": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w.])",
}


def checked(custom: dict[str, str]) -> dict[str, re.Pattern]:
    """The detectors with custom ones, each of which must compile and match something."""
    out = {k: re.compile(v) for k, v in DETECTORS.items()}
    for name, pattern in custom.items():
        try:
            compiled = re.compile(pattern)
        except re.error as e:
            raise ValueError(f"{name}: {e}") from e
        if compiled.match(""):
            raise ValueError(f"{name} matches an empty text")
        out[name] = compiled
    return out


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def _plausible(name: str, found: str) -> bool:
    """A card number passes its check digit, a phone number has 7 to 15 digits."""
    if name == "phone":
        return 7 <= sum(c.isdigit() for c in found) <= 15
    if name == "ipv6-address":
        try:
            return ipaddress.ip_address(found).version == 6
        except ValueError:
            return False
    return name != "credit-card" or _luhn(found)


def spans(text: str, detectors: dict[str, re.Pattern]) -> list[tuple[int, int, str]]:
    """Spans by start, the longest first; later ones that overlap go."""
    found = [(m.start(), m.end(), name) for name, p in detectors.items() for m in p.finditer(text) if _plausible(name, m.group())]
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0], -s[1], list(detectors).index(s[2]))):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def redact(text: str, detectors: dict[str, re.Pattern], mode: str = "replace", key: bytes = b"") -> tuple[str, dict[str, int]]:
    out, at, counts = [], 0, {}
    for a, b, name in spans(text, detectors):
        put = {"remove": "", "replace": f"[{name}]"}.get(mode) if mode != "hash" else f"[{name}:{hmac.new(key, text[a:b].encode(), hashlib.sha256).hexdigest()[:16]}]"
        out += [text[at:a], put]
        counts[name] = counts.get(name, 0) + 1
        at = b
    return "".join([*out, text[at:]]), counts


def redacted(rows: DataFrame, id_col: str, text_col: str, mode: str = "replace", key: bytes = b"", custom: dict[str, str] | None = None) -> DataFrame:
    """``id, text, counts``. Rows without a digit, an at sign or a pair of colons hold none of the built-in kinds;
    without custom detectors they go past Python, as they are."""
    detectors = checked(custom or {})

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))]))
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [redact(t or "", detectors, mode, key) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "counts": [d[1] for d in done]})

    found = lambda part: part.select(id_col, run(text_col).alias("r")).select(id_col, "r.text", "r.counts")
    if custom:
        return found(rows)
    some = F.coalesce(F.col(text_col).rlike("[0-9@]|::"), F.lit(False))
    none = F.create_map().cast("map<string,int>")
    return found(rows.where(some)).unionByName(rows.where(~some).select(id_col, F.coalesce(text_col, F.lit("")).alias("text"), none.alias("counts")))


def mention_counts(text: Column) -> dict[str, Column]:
    """Counts of single kinds in expressions."""
    return {"n_email": F.regexp_count(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")), "n_ip": F.regexp_count(text, F.lit(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"))}


# --- citations ---------------------------------------------------------------------------

MARKER = r"\[\[cite:([0-9]{1,4}(?:,[0-9]{1,4})*)\]\]"


def slots(text: Column) -> Column:
    """The passages that an answer's markers name, each once, in order."""
    lists = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda n: n.cast("int")))


def malformed(text: Column) -> Column:
    """Markers that open but aren't well formed."""
    return F.regexp_count(text, F.lit(r"\[\[cite:")) - F.regexp_count(text, F.lit(MARKER))


def bound(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """``answer_id, slot, chunk_id, outcome`` of each slot, from ``answer_id, text`` and ``answer_id, slot, chunk_id``."""
    cited = answers.select("answer_id", F.posexplode(slots(F.col("text"))).alias("at", "slot"))
    joined = cited.join(passages, ["answer_id", "slot"], "left")
    first = Window.partitionBy("answer_id", "chunk_id").orderBy("at")
    again = F.col("chunk_id").isNotNull() & (F.row_number().over(first) > 1)
    return joined.select("answer_id", "slot", "chunk_id", F.when(F.col("chunk_id").isNull(), "unknown_slot").when(again, "repeated").otherwise("bound").alias("outcome"))


def accounted(bindings: DataFrame, answers: DataFrame) -> DataFrame:
    sums = bindings.groupBy("answer_id").agg(F.count_if(F.col("outcome") == "bound").alias("n_bound"), F.count_if(F.col("outcome") != "bound").alias("n_dropped"))
    joined = answers.select("answer_id").join(sums, "answer_id", "left")
    n = F.coalesce("n_bound", F.lit(0))
    return joined.select("answer_id", n.alias("n_bound"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), (n == 0).alias("ungrounded"))


def verified(bindings: DataFrame, passages: DataFrame, anchors: DataFrame) -> DataFrame:
    """The ladder bound, located, resolved: ``anchors`` has ``chunk_id, anchor, resolved_text``."""
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    joined = bindings.where("outcome = 'bound'").join(passages.select("chunk_id", "text"), "chunk_id", "left").join(anchors, "chunk_id", "left")
    rung = F.when(F.col("anchor").isNull(), "bound").when(F.col("resolved_text").isNull() | ~F.contains(normal(F.col("resolved_text")), normal(F.col("text"))), "located").otherwise("resolved")
    return joined.select("answer_id", "slot", "chunk_id", rung.alias("rung"))


def neutral(text: Column) -> Column:
    """Markers that can't be read as such any more."""
    return F.regexp_replace(text, r"\[\[(cite:)", "[​[$1")


class MarkerScanner:
    """Reads an answer piece by piece: emits text and slots, keeps what may yet become a marker."""

    def __init__(self, longest: int = 64) -> None:
        self.held, self.longest, self.seen = "", longest, set()

    def feed(self, piece: str) -> list[tuple[str, object]]:
        self.held += piece
        return self._drain(False)

    def close(self) -> list[tuple[str, object]]:
        return self._drain(True)

    def _drain(self, last: bool) -> list[tuple[str, object]]:
        out: list[tuple[str, object]] = []
        opener = "[[cite:"
        while self.held:
            at = self.held.find("[")
            if at != 0:
                text, self.held = (self.held, "") if at < 0 else (self.held[:at], self.held[at:])
                out.append(("text", text))
                continue
            if not self.held.startswith(opener):
                if opener.startswith(self.held) and not last:
                    break
                out.append(("text", self.held[0]))
                self.held = self.held[1:]
                continue
            end = self.held.find("]]")
            if end < 0:
                if len(self.held) <= self.longest and not last:
                    break
                out.append(("unterminated", self.held[: self.longest]))
                self.held = self.held[self.longest :]
                continue
            marker, self.held = self.held[: end + 2], self.held[end + 2 :]
            m = re.fullmatch(MARKER, marker)
            if m is None or len(marker) > self.longest:
                out.append(("malformed", marker))
                continue
            new = [n for n in dict.fromkeys(map(int, m[1].split(","))) if n not in self.seen]
            self.seen.update(new)
            out.append(("slots", new))
        return out


# --- boundaries and lineage ---------------------------------------------------------------

#: What ends a heading and begins what it says (fixed values).
SEPARATORS = r"\s+[-–—]\s+|:\s+|\s+=\s+"


def heading_and_description(line: Column) -> Column:
    """``heading, description`` of a line ``TERM — what it is``: cut at its first separator; a line without one is all heading."""
    parts = F.split(F.trim(line), SEPARATORS, 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("heading"), F.trim(F.get(parts, F.lit(1))).alias("description"))


def lineage(rules: dict[str, str], libraries: dict[str, str], hooks: tuple[str, ...] = ()) -> str:
    """A digest of all that a detected glossary depends on; entries of another one are detected again."""
    import json

    return hashlib.sha256(json.dumps([sorted(rules.items()), sorted(libraries.items()), list(hooks)]).encode()).hexdigest()[:32]


def undetected(documents: DataFrame, current: str) -> DataFrame:
    """Documents whose entries were detected under another lineage, or not at all."""
    return documents.where(~F.col("glossary_fp").eqNullSafe(F.lit(current)))


def with_previous(chunks: DataFrame) -> DataFrame:
    """``chunk_id, line_no, line, previous``: each line of a text, numbered from 1, with the one before, empty for the first."""
    lines = chunks.select("chunk_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return lines.withColumn("previous", F.lag("line", 1, "").over(Window.partitionBy("chunk_id").orderBy("line_no")))
