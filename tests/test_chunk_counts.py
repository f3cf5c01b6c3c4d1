"""A text's tokens are counted when it is cut; groups have the sum of theirs."""

import random
import re

import pytest

from folioforge.operators import chunking, parsing

BITS = ["alpha", "Beta", "gamma-ray", "3.5", "Dr.", "naïve", "é́", "!!!", "a_b", "中文。", "e.g.", "?", "-" * 5, "w" * 40, '."', "\x1c", "\t", "\n", "\n\n"]


def _blocks(rng):
    made = []
    for _ in range(rng.randrange(8)):
        text = rng.choice([" ", "\n", ""]).join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 5, 20, 80])))
        made.append({"kind": rng.choice(["heading", "prose", "prose", "list", "code", "table"]), "text": text, "heading_path": rng.choice([[], ["h1"], ["h1", "h2 x"]]), "header_rows": rng.choice([0, 1, 2]), "lang": rng.choice([None, "dot"])})
    return made


@pytest.mark.parametrize("budget", [chunking.Budget(40, 10, 8, 10), chunking.Budget(24, 0, 6, 4), chunking.Budget(256, 32, 32, 32), chunking.Budget(12, 4, 2, 0)])
def test_sums_are_what_a_count_of_the_joined_text_gives(budget):
    rng = random.Random(budget.most)
    made = 0
    for _ in range(400):
        blocks = _blocks(rng)
        got = chunking.chunk("A title", blocks, budget)
        assert got == chunking.chunk("A title", blocks, budget, lambda t: chunking.count_tokens(t))
        assert all(c["token_count"] == chunking.count_tokens(c["embed_text"]) for c in got)
        made += len(got)
    assert made > 400


def test_a_text_is_not_counted_again_as_its_group_grows(monkeypatch):
    class Counting:
        read = 0

        def findall(self, text):
            Counting.read += len(text)
            return pieces.findall(text)

        def finditer(self, text):
            Counting.read += len(text)
            return pieces.finditer(text)

    pieces: re.Pattern = chunking.PIECE
    monkeypatch.setattr(chunking, "PIECE", Counting())
    text = " ".join(f"Sentence {i} has six words." for i in range(5_000))
    assert len(chunking.chunk("T", [{"kind": "prose", "text": text, "heading_path": []}], chunking.Budget(256, 32, 32, 32))) > 100
    assert Counting.read < 2 * len(text)


def test_a_long_word_is_cut_at_the_token_that_is_too_many():
    text = "ab-" * 3_000
    parts = chunking.hard_split(text, 20)
    assert parts == ["ab-" * 10] * 300 and chunking.longest_prefix(" ab cd", 0) == 1 and chunking.longest_prefix("ab cd ", 1) == 3


def test_bytes_are_judged_by_their_control_characters():
    assert parsing.probably_text(b"") and parsing.probably_text(b"a\t\n\x0b\x0c\r" * 9) and not parsing.probably_text(b"a\0")
    assert parsing.probably_text(b"\x1b" * 4 + b"a" * 96) and not parsing.probably_text(b"\x1b" * 5 + b"a" * 95)
