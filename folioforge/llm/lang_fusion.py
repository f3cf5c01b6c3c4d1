"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

A text's likelihood under each language is that of its hashed byte trigrams of letters and
blanks, A-Z lower-cased, from counts over a bounded sample of labelled texts; one more hypothesis, no language at
all, spreads its mass over all trigrams. By the text alone every row gets a first guess.
Grouped sums of these guesses then give the likelihoods of what a row declares and of its
address suffix, and the priors of its host, smoothed towards its suffix's, which are
smoothed towards the whole table's. A row's own guess is taken out of its groups' sums, so no
row is evidence for itself. The posterior is their product; a row is rejected if no
language reaches ``LEAST`` of it or if it isn't one of those wanted. A row that declares a language
without a model can't reach it and isn't rejected for that.

The likelihood of a text counts at most as ``EVIDENCE`` trigrams of it, since neighbouring
ones depend on each other; otherwise no other evidence could ever count.

Cases: a null or empty text has no likelihood of its own, and a declared language, suffix or
host that is null or never met adds nothing, so a row without any evidence has the prior; a very
long text is read whole;
ties go to the first language by name; repeated rows, and those without an id, stay; an empty
table gives no rows; further columns are not read by ``fused`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import bounded_sample, flat_bytes, slices, stretch, tidy, unused
from folioforge.plans.scratch import written

SAMPLE = 1500
LONGEST_SAMPLE = 20_000
#: Languages with a model of their own, by the number of their texts; the others share one, by the code of uncoded languages.
MOST_LANGUAGES, OTHERS = 128, "mis"
BUCKETS = 1 << 16
SMOOTHING = 0.1
EVIDENCE = 60.0
#: What a host's and a suffix's own rows have to weigh to count as much as what they fall back on.
HOST_STRENGTH, SUFFIX_STRENGTH, FIELD_STRENGTH = 50.0, 50.0, 20.0
#: Prior of no language, and the posterior that a language must reach.
NONE_PRIOR, LEAST = 0.01, 0.5
NONE = "und"


def _trigrams(flat: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams that start at each byte but the last two; 0 if they hold a digit or mark,
    as these tell no language."""
    low = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    whole = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    plain = ((low >= 97) & (low <= 122)) | (low >= 128) | (low == 32)
    bucket = ((whole * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % (BUCKETS - 1) + 1
    return bucket * (plain[:-2] & plain[1:-1] & plain[2:])


def train(docs: DataFrame, lang: str, id_col: str, text_col: str, sample: int = SAMPLE, longest: int = LONGEST_SAMPLE, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the log-likelihood of each bucket under each and under none.

    Every language with a text that holds a trigram has a model, the ``most`` of the most texts one of their
    own and all others together that of ``OTHERS``. The sample is ``sample`` texts per model at most; of a
    text longer than ``longest`` it has a window placed by its id.
    """
    shown = stretch(F.col(text_col), F.col(id_col), longest)
    known = docs.where(F.col(lang).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang).alias("lang"), F.col(id_col).cast("string").alias("id"), shown.alias("text"))
    common = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).select("lang").collect()]
    if len(common) > most:
        known = known.withColumn("lang", F.when(F.col("lang").isin(common[:most]), F.col("lang")).otherwise(OTHERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a task, by language."""
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = np.bincount(_trigrams(np.frombuffer(text.encode(), np.uint8)), minlength=BUCKETS)
                held[name] = held[name] + found if name in held else found
        for name, found in held.items():
            at = np.flatnonzero(found[1:]) + 1
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(found[at])], ["lang", "bucket", "n"])

    summed = bounded_sample(known, "lang", "id", sample).select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A row per model and bucket at most.
    counts = summed.toPandas()
    names = sorted(counts["lang"].unique().tolist())
    rows = np.full((len(names) + 1, BUCKETS), SMOOTHING)
    rows[np.searchsorted(np.array(names, object), counts["lang"].to_numpy(object)) if names else [], counts["bucket"]] += counts["n"]
    rows[-1] = 1.0
    rows[:, 0] = 0
    table = np.zeros(rows.shape, np.float32)
    table[:, 1:] = np.log(rows[:, 1:] / rows.sum(1, keepdims=True))
    return names, table


def likelihoods(rows: DataFrame, table: np.ndarray, prior: np.ndarray, keys: list[str], text_col: str) -> DataFrame:
    """Adds two arrays over the languages and none to the columns ``keys``: ``loglik``, and ``guess``, the
    posterior by the text and the prior alone."""
    shared = rows.sparkSession.sparkContext.broadcast(table)  # MOST_LANGUAGES and two more x BUCKETS numbers at most
    kept = rows.select(*keys, F.col(text_col).alias("__text"))
    schema = kept.drop("__text").schema.add("loglik", T.ArrayType(T.DoubleType())).add("guess", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20):
                flat, offsets = flat_bytes(batch.column("__text"))
                grams = _trigrams(flat)
                n = np.maximum(np.diff(offsets) - 2, 0)
                out = np.zeros((len(n), len(score)))
                live = np.flatnonzero(n)
                if len(live):
                    # A row's trigrams, and after them the two that run over into the next row.
                    edges = np.stack((offsets[:-1][live], offsets[:-1][live] + n[live]), 1).reshape(-1)
                    edges = edges[:-1] if edges[-1] >= len(grams) else edges
                    for j, s in enumerate(score):
                        out[live, j] = np.add.reduceat(s[grams].astype(np.float64), edges)[::2]
                    told = np.zeros(len(n))
                    told[live] = np.add.reduceat(grams > 0, edges, dtype=np.int64)[::2]
                    out *= np.minimum(1.0, EVIDENCE / np.maximum(told, 1))[:, None]
                guess = out + np.log(prior)
                guess = np.exp(guess - guess.max(1, keepdims=True))
                guess /= guess.sum(1, keepdims=True)
                ends = pa.array(np.arange(0, out.size + 1, len(score)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))) for v in (out, guess)]
                yield pa.record_batch([*[batch.column(k) for k in keys], *lists], [*keys, "loglik", "guess"])
        tidy()

    return kept.mapInArrow(run, schema)


def _summed(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Per group, the guesses' sums ``mass`` (an array) over all its rows."""
    sums = [F.sum(F.get("guess", F.lit(j))).alias(f"__m{j}") for j in range(n)]
    return rows.groupBy(*by).agg(*sums).select(*by, F.array(*[f"__m{j}" for j in range(n)]).alias("mass"))


def _matrix(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x n of a column of arrays, zeros for a null one, and which are not null."""
    known = np.asarray(column.is_valid())
    out = np.zeros((len(column), n))
    out[known] = np.asarray(column.drop_null().flatten(), np.float64).reshape(-1, n)
    return out, known


def _share(mass: np.ndarray, guess: np.ndarray, towards: np.ndarray, strength: float) -> np.ndarray:
    """Smoothed shares of the groups' masses, each without the row's own guess."""
    others = np.maximum(mass - guess, 0)
    return (others + strength * towards) / (others.sum(1, keepdims=True) + strength)


def fused(rows: DataFrame, id_col: str, text_col: str, model: tuple[list[str], np.ndarray], declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """One row per row: ``id_col, lang_pred, confidence, lang_text, accepted``."""
    names, table = model
    labels = [*names, NONE]
    n = len(labels)
    nothing = F.lit(None).cast("string")
    fields = {"declared": declared, "suffix": suffix, "host": host}
    given = rows.select(F.col(id_col), F.col(text_col), *[(nothing if c is None else c.cast("string")).alias(f"__{k}") for k, c in fields.items()])
    keys = [id_col, "__declared", "__suffix", "__host"]
    base = np.array([(1 - NONE_PRIOR) / max(1, len(names))] * len(names) + [NONE_PRIOR])
    guessed = written(likelihoods(given, table, base, keys, text_col), "likelihoods")
    # One row: the whole table's sums; one per value of a field, or per host and suffix, for the rest.
    whole = _summed(guessed, [], n).withColumnRenamed("mass", "__all")
    out = guessed.crossJoin(F.broadcast(whole))
    masses = ["__all"]
    for field, given_it in (("__declared", declared), ("__suffix", suffix)):
        if given_it is not None:
            masses.append(f"{field}_mass")
            out = out.join(_summed(guessed.where(f"{field} is not null"), [field], n).withColumnRenamed("mass", masses[-1]), field, "left")
    if host is not None:
        masses.append("__host_mass")
        hosts = _summed(guessed.where("__host is not null"), ["__host", "__suffix"], n).select(F.col("__host").alias("__h"), F.col("__suffix").alias("__s"), F.col("mass").alias("__host_mass"))
        out = out.join(hosts, (F.col("__host") == F.col("__h")) & F.col("__suffix").eqNullSafe(F.col("__s")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = np.array(labels)
        for batch in batches:
            loglik, guess = (_matrix(batch.column(c), n)[0] for c in ("loglik", "guess"))
            mass = {c: _matrix(batch.column(c), n) for c in masses}
            everyone = mass["__all"][0]
            everyone = (everyone + base) / (everyone.sum(1, keepdims=True) + 1)
            start = everyone
            for c, strength in (("__suffix_mass", SUFFIX_STRENGTH), ("__host_mass", HOST_STRENGTH)):
                if c in mass:
                    start = np.where(mass[c][1][:, None], _share(mass[c][0], guess, start, strength), start)
            total = loglik + np.log(start)
            if declares:
                # The log of P(value | language) over P(value).
                value, known = mass["__declared_mass"]
                total += np.where(known[:, None], np.log(_share(value, guess, everyone, FIELD_STRENGTH) / everyone), 0)
            posterior = np.exp(total - total.max(1, keepdims=True))
            posterior /= posterior.sum(1, keepdims=True)
            best = posterior.argmax(1) if len(posterior) else np.zeros(0, np.int64)
            confidence = posterior.max(1) if len(posterior) else np.zeros(0)
            good = (best < n - 1) & (confidence >= LEAST)
            if wanted is not None:
                good &= np.isin(said[best], wanted)
            if declares:
                names_of = batch.column("__declared").to_pylist()
                unmodelled = np.array([d is not None and d not in modelled and (wanted is None or d in wanted) for d in names_of], bool)
                good |= unmodelled
            by_text = loglik.argmax(1) if len(loglik) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(id_col), pa.array(said[best].tolist(), pa.string()), pa.array(confidence), pa.array(said[by_text].tolist(), pa.string()), pa.array(good)], [id_col, "lang_pred", "confidence", "lang_text", "accepted"])

    declares, modelled = declared is not None, frozenset(names)
    schema = guessed.select(id_col).schema.add("lang_pred", T.StringType()).add("confidence", T.DoubleType()).add("lang_text", T.StringType()).add("accepted", T.BooleanType())
    return out.select(id_col, "__declared", "loglik", "guess", *masses).mapInArrow(run, schema)


def accepted(docs: DataFrame, id_col: str, text_col: str, model: tuple[list[str], np.ndarray], **fields) -> DataFrame:
    """The rows whose language is accepted, with their own columns."""
    name = unused(docs, "gone")
    gone = fused(docs, id_col, text_col, model, **fields).where("not accepted").select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[name]), "left_anti")
