"""Language identification by inferring each document's mixture of languages.

Fitting counts byte trigrams (A-Z lower-cased, hashed into BUCKETS) per language
over a sample of labelled documents of bounded expected size. A document is then
a bag of trigrams drawn from a mixture of the languages' distributions, and
expectation-maximisation finds the proportions. The set of languages grows from
the likeliest single one, taking the next by its share in the full mixture, for
as long as the log-likelihood gains more than a penalty in proportion to
log(trigrams). The prediction is the set's language of greatest share and the
score is that share.

Defined results: `und` with score 0 for a null text, one without a letter, or
if no labels exist; ties go to the language first by name; rows with a null
lang are not learned from; repeated rows score alike; a text of over 4 BUCKETS
trigrams is inferred from its counts, with the same result; an empty table gives
no rows; extra columns pass through, but for those of the results' names. Over
LANGUAGES labels are an error, since a model holds BUCKETS numbers for each: no
language is dropped without notice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.llm.common import ASCII_LOWER, crc_mod

BUCKETS = 1 << 16
#: Expected labelled documents a language that are learned from.
SAMPLE = 6000
#: Languages of a model: 64 MB at this number, which go to every task.
LANGUAGES = 256
#: Add-this smoothing of a bucket; EM rounds; penalty of a language, in log(trigrams).
SMOOTHING, ROUNDS, PENALTY = 0.1, 12, 4.0
#: Trigrams whose likelihoods are held at a time.
BLOCK = 1 << 18


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram, with a space before and behind the text."""
    b = np.frombuffer(b" " + text.encode().translate(ASCII_LOWER) + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Mixture:
    """Trigram probabilities of the languages, in name order."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts.astype(np.float64) + SMOOTHING
        self.table = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T, np.float32)  # (bucket, language)

    def _em(self, parts: list[tuple[np.ndarray, np.ndarray]], chosen: list[int], start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """Shares of the chosen languages, and the log-likelihood."""
        share = start.astype(np.float32)
        total = float(sum(w.sum() for _, w in parts))
        own = [(p if len(chosen) == p.shape[1] else np.ascontiguousarray(p[:, chosen]), w) for p, w in parts]
        for _ in range(rounds if len(chosen) > 1 else 0):
            moved = np.zeros(len(chosen), np.float32)
            for p, w in own:
                moved += (w / (p @ share)) @ p
            new = share * moved / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, sum(float(w @ np.log(p @ share)) for p, w in own)

    def infer(self, text: str) -> dict[int, float]:
        """Shares of the selected languages."""
        grams, n = trigrams(text), len(self.names)
        if len(grams) > 4 * BUCKETS:  # a very long text is its counts
            counts = np.bincount(grams, minlength=BUCKETS)
            grams = np.flatnonzero(counts)
            weights = counts[grams].astype(np.float32)
        else:
            weights = np.ones(len(grams), np.float32)
        parts = [(self.table[grams[i : i + BLOCK]], weights[i : i + BLOCK]) for i in range(0, len(grams), BLOCK)]
        total = float(weights.sum())
        full, _ = self._em(parts, list(range(n)), np.full(n, 1 / n), ROUNDS)
        order = np.argsort(-full, kind="stable")
        chosen, share, best = [int(order[0])], np.ones(1, np.float32), None
        best = self._em(parts, chosen, share, 0)[1]
        for extra in order[1:]:
            tried = [*chosen, int(extra)]
            start = np.maximum(full[tried], 1e-4)
            new, fit = self._em(parts, tried, start / start.sum(), ROUNDS)
            if fit - best <= PENALTY * np.log(total + 1):
                break
            chosen, share, best = tried, new, fit
        return {i: float(s) for i, s in zip(chosen, share / share.sum())}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return "und", 0.0
        found = self.infer(text)
        top = min(found, key=lambda i: (-found[i], i))
        return self.names[top], min(1.0, max(0.0, found[top]))


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, most: int = LANGUAGES) -> Mixture:
    """Trigram counts over about `sample` whole documents of each language, of at most `most`, where `learn` holds.

    A language's documents are taken if the hash of their id is below a bound
    set from the language's count, so nothing is sorted or collected but the
    summed counts, BUCKETS to a language.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = sorted(rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect(), key=lambda r: r["lang"])  # a row a language
    if len(sizes) > most:
        raise ValueError(f"lang has over {most} values, a model holds {most} languages at most")
    names = [r["lang"] for r in sizes]
    if not names:
        return Mixture([], np.zeros((0, BUCKETS)))
    spread = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30))
    bounds = {r["lang"]: int(min(1.0, sample / r["n"]) * (1 << 30)) for r in sizes}
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv]), F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                if lang.as_py() not in counts:
                    counts[lang.as_py()] = np.zeros(BUCKETS, np.int64)
                counts[lang.as_py()] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(c[at])], ["lang", "bucket", "n"])

    chosen = rows.where(spread < bound).select("text", "lang")
    summed = chosen.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), BUCKETS))
    place = {x: i for i, x in enumerate(names)}
    for r in summed.toLocalIterator():
        counts[place[r["lang"]], r["bucket"]] = r["n"]
    return Mixture(names, counts)


def identify(docs: DataFrame, model: Mixture, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction and the score, from text alone, in columns `out`, which replace any of those names."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = docs.drop(*out)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(names.index("text"))]
            arrays = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*names, *out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out[0], StringType()).add(out[1], DoubleType()))


def languages(
    docs: DataFrame, held_out: int | None = 4, remainder: int = 2, sample: int = SAMPLE, out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """docs with the columns `out`; learns where crc32(doc_id) mod held_out is not remainder (None: everywhere)."""
    learn = F.lit(True) if held_out is None else crc_mod("doc_id", held_out) != remainder
    return identify(docs, fit(docs, learn, sample), out)
