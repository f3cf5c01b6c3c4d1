"""Text functions as Column expressions; those marked so run in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """The same runs with a blank between them, and perhaps one at either end."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def word_pieces(text: Column) -> Column:
    """Number of words and single marks: the offline token count."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slugify(text: Column) -> Column:
    """Lower case, marks dropped, blanks as hyphens."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), r"^-+|-+$", "")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\\n[ \\t]*\\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def strip_extension(title: Column) -> Column:
    """A title without a file suffix of up to five letters or digits."""
    return F.regexp_replace(title, r"\.[A-Za-z0-9]{1,5}$", "")


def normal_key(text: Column) -> Column:
    """Lower case, single blanks, marks at the ends dropped: the form that phrases are compared in."""
    return F.trim(F.regexp_replace(collapse(F.lower(text)), r"[\s.!?,;:]+$", ""))


def acronym_key(text: Column) -> Column:
    """Upper case without dots, blanks and hyphens; null unless of 2 to 12 letters or digits, a letter first."""
    key = F.upper(F.regexp_replace(F.trim(text), r"[.\s\-/&'’]", ""))
    return F.when(key.rlike(r"^[A-Z][A-Z0-9]{1,11}$"), key)


def acronym_shaped(text: Column) -> Column:
    """At least two letters, the first a capital, three in five capitals at least."""
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]", ""))
    return text.rlike(r"^[A-Z]") & (letters >= 2) & (capitals >= 0.6 * letters)


#: Words that an acronym may skip (fixed values).
SKIPPED = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def initials(text: Column, skip: bool = True) -> Column:
    """First letters of the words, upper-cased; with ``skip``, not of function words."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*SKIPPED)) if skip else words
    return F.upper(F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), ""))


def initial_skeleton(text: Column) -> Column:
    """The capitals and digits, if there are three of them."""
    kept = F.regexp_replace(text, r"[^A-Z0-9]", "")
    return F.when(F.length(kept) >= 3, kept)


def brackets_balance(text: Column) -> Column:
    """Whether every bracket closes the last one open, by a fold over the brackets of a text."""
    marks = F.split(F.regexp_replace(text, r"[^()\[\]{}]", ""), "")
    pair = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])

    def step(open_: Column, c: Column) -> Column:
        top = F.substring(open_, -1, 1)
        closed = F.when(top == F.element_at(pair, c), F.expr("''")).otherwise(F.lit("!"))
        popped = F.when(closed == "", F.when(F.length(open_) > 0, F.left(open_, F.length(open_) - 1)).otherwise("")).otherwise("!")
        return F.when(open_.startswith("!") | (c == ""), open_).when(F.array_contains(F.map_keys(pair), c), popped).otherwise(F.concat(open_, c))

    return F.aggregate(marks, F.lit(""), step) == ""


def origin_of(url: Column) -> Column:
    """Scheme, host and port that isn't the scheme's own, lower-cased; null if there is none."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(own, "").otherwise(F.concat(F.lit(":"), port))))


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a column from 1 on, for up to three letters."""
    letter = lambda n: F.chr((65 + n).cast("int"))
    one = letter(index - 1)
    two = F.concat(letter(F.floor((index - 27) / 26)), letter(F.pmod(index - 27, F.lit(26))))
    three = F.concat(letter(F.floor((index - 703) / 676)), letter(F.pmod(F.floor((index - 703) / 26), F.lit(26))), letter(F.pmod(index - 703, F.lit(26))))
    return F.when(index <= 26, one).when(index <= 702, two).otherwise(three)


def column_index(letters: Column) -> Column:
    """Number of a spreadsheet column, from 1 on."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, in Arrow batches: there is no such function in the engine."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """Without combining marks, in Arrow batches."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def _shape(stem: str) -> str:
    """Vowels and consonants of a stem, runs as one letter; y counts as a vowel after a consonant."""
    kinds = []
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and i > 0 and kinds[-1] == "c")
        kinds.append("v" if vowel else "c")
    return "".join(kinds)


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


#: Suffix rules of the published algorithm, steps 2 to 4 (fixed values).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case English word (Porter 1980)."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and "v" in _shape(w[: -len(s)]):
                w, again = w[: -len(s)], True
                break
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        s = _longest(w, [r[0] for r in rules])
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + dict(rules)[s]
    s = _longest(w, _STEP4)
    if s:
        stem = w[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(terms: pd.Series) -> pd.Series:
    """The stems of an array of terms, in Arrow batches."""
    return terms.map(lambda ts: None if ts is None else [porter(t) for t in ts])


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object of text fields as JSON in one form: names in order, absent fields left out, so equal objects have equal digests."""
    named = [F.when(fields[name].isNotNull(), F.struct(F.lit(name).alias("key"), fields[name].cast("string").alias("value"))) for name in sorted(fields)]
    return F.to_json(F.map_from_entries(F.filter(F.array(*named), lambda e: e.isNotNull())))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from the first on."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    both = F.slice(same, F.lit(1), F.least(F.size(a), F.size(b)))
    first = F.array_position(both, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(both)).otherwise(first - 1)


def shared_suffix(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common up to the last."""
    return shared_prefix(F.reverse(a), F.reverse(b))


#: Words after which a full stop ends no sentence, besides single letters (fixed values).
ABBREVIATIONS = ("al", "approx", "cf", "dr", "e.g", "eg", "esp", "etc", "fig", "i.e", "ie", "inc", "jr", "ltd", "mr", "mrs", "ms", "no", "pp", "prof", "sr", "st", "vs", "vol")
#: A mark that may end a sentence, what may close it, the space after it, and how the next one begins (fixed values).
ENDS, CLOSERS, OPENERS = "[.!?]", "[\"'”’)\\]]?", "[\"'“‘(\\[]?[A-Z0-9]"
#: The end of a part that goes on: an abbreviation or a single letter before its mark.
GOES_ON = rf"(?i)(?:^|[^A-Za-z.])\.*(?:{'|'.join(w.replace('.', chr(92) + '.') for w in ABBREVIATIONS)}|[A-Za-z])\.*{ENDS}{CLOSERS}$"
#: More characters than the end of a part has that goes on: one before it, an abbreviation, its mark, what closes it, a line's end.
TAIL = 12
#: Stands between parts while a text is cut; taken out of texts before.
MARK = "\u0001"


def goes_on(part: Column) -> Column:
    """Whether a part ends in an abbreviation or a single letter. Its last characters tell, unless they are letters and
    dots alone; a search of the whole part tries the rule at every character."""
    tail, whole = F.substring(part, -TAIL, TAIL), F.rlike(part, F.lit(GOES_ON))
    open_ = F.rlike(tail, F.lit(f"^[A-Za-z.]*{ENDS}{CLOSERS}$"))
    return F.when(F.length(part) <= TAIL, whole).when(open_, whole).otherwise(F.rlike(tail, F.lit(GOES_ON)))


def sentences(text: Column) -> Column:
    """A text's sentences in order, all in expressions: cut where a mark, space and a beginning meet, then joined again
    after an abbreviation or a single letter."""
    clean = F.regexp_replace(F.regexp_replace(text, MARK, ""), r"^\s+|\s+$", "")
    parts = F.split(F.regexp_replace(clean, f"({ENDS}{CLOSERS})(\\s+)(?={OPENERS})", f"$1{MARK}$2"), MARK)
    told = F.transform(parts, lambda p: F.struct(p.alias("part"), goes_on(p).alias("on")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        now = F.concat(acc["open"], p["part"])
        stays = p["on"] | ((acc["open"] != "") & goes_on(now))
        return F.struct(F.when(stays, acc["done"]).otherwise(F.concat(acc["done"], F.array(now))).alias("done"), F.when(stays, now).otherwise("").alias("open"))

    folded = F.aggregate(told, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.filter(F.transform(folded, lambda x: F.regexp_replace(x, r"^\s+", "")), lambda x: x != "")
