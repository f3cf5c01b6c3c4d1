"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, size long, stay string, signature string"
WORDS = "the of and oren hely lyther innd bosbt thandedble queeau ist una edhawh on erhe anre ouinsh".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    base = [words(rng, rng.choice([1, 3, 5, 20, 60, 120])) for _ in range(n)]
    for i in range(0, n, 3):  # near copies of several strengths
        w = base[(i + 1) % n].split(" ")
        for _ in range(max(1, len(w) // rng.choice([60, 30, 15, 8]))):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
        base[i] = " ".join(w)
    extra = [None, "", " \t\n", "A b C", "a b c", "a b c", "one two three four", "ONE two three four", "Ünïcode ÄÖ ß 日本語 😀", " lead and tail ", "x  y\n\nz", "no" * 40_000, words(rng, 6000), "<|endoftext|> a"]
    return base + extra + base[:5]


def rows(seed: int = 1, n: int = 60):
    found = texts(seed, n)
    out = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "S2", "é"][i % 5], None, i, i, "x", "y") for i, t in enumerate(found)]
    return [*out, out[7], out[7]]


def docs(spark, seed: int = 1, n: int = 60):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
