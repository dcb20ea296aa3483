"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams. A text is lower-cased; runs of characters that are neither letters nor marks count as one
space. Its n-grams are single letters, pairs and triples of characters, without those that reach
over a space in their middle. Each is one exact 64-bit number (21 bits a code point), not a hash.

Dictionary. For every language Spark counts in how many of all training documents each n-gram
stands. The features are the n-grams that stand in MIN_SHARE of some language's documents, and in
two of them. A document has a bounded number of n-grams on average, so a language adds at most that
number / MIN_SHARE features, however large the corpus is. Document frequencies, summed over
languages, give the inverse frequencies.

Model. One weight a feature and language, trained by follow-the-regularised-leader with an L1 and
an L2 penalty (the first sets weights to zero exactly) on at most `max_rows` training documents,
chosen by hashes of their texts, as many from each language as from the others where it has them
(a documented bound; dictionary and frequencies cover all). One chosen document in CALIBRATION is
kept from training and gives the temperature by which scores are divided.

Edge cases: null texts and texts without a letter are `und` with score 0; texts whose n-grams are
all unknown get the language of the largest intercept; without training documents every text is
`und`; null ids count as the empty text for the fold; empty language names are names; repeated rows
count as often as they stand there and are predicted alike; an empty table gives an empty result;
other columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, durable, pieces, read

BITS = 21
SPACE = 0x20
MIN_SHARE = 0.01
MAX_ROWS = 6_000
CALIBRATION = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.1, 1.0
KEYS_AT_ONCE = 2_000_000
UNKNOWN, OTHER, MARK, LETTER = 0, 1, 2, 3
UNDETERMINED = "und"


class Characters:
    """What kind each code point is, found out when it is first met."""

    def __init__(self) -> None:
        self.kind = np.zeros(0x110000, np.uint8)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        found = self.kind[points]
        if not found.all():
            for p in np.unique(points[found == UNKNOWN]).tolist():
                self.kind[p] = {"L": LETTER, "M": MARK}.get(unicodedata.category(chr(p))[0], OTHER)
            found = self.kind[points]
        return found


@lru_cache(maxsize=1)
def characters() -> Characters:
    """One for each worker."""
    return Characters()


def n_grams(text: str | None) -> np.ndarray:
    """The n-grams of a text as numbers, one for each occurrence; none where it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    kinds = characters().kinds(points)
    if not (kinds == LETTER).any():
        return np.zeros(0, np.int64)
    line = np.full(len(points) + 2, SPACE, np.int64)
    line[1:-1] = np.where(kinds >= MARK, points, SPACE)
    gap = line == SPACE
    line = line[~(gap & np.concatenate([[False], gap[:-1]]))]
    inner = line != SPACE
    pairs = (line[:-1] << BITS) | line[1:]
    triples = (pairs[:-1] << BITS) | line[2:]
    return np.concatenate([line[inner], pairs, triples[inner[1:-1]]])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, gram, n: in how many texts of a language an n-gram stands; gram -1 counts its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(times)], names=["lang", "gram", "n"])
            held.clear()

        for batch in pieces(batches):
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                own = np.append(pd.unique(n_grams(text.as_py())), -1)
                held.setdefault(lang.as_py(), []).append(own)
                n += len(own)
                if n > KEYS_AT_ONCE:
                    yield from flush()
                    n = 0
        yield from flush()

    parts = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Features:
    """Numbers of known n-grams, found by a table of open addresses, and their inverse frequencies."""

    def __init__(self, grams: np.ndarray, idf: np.ndarray) -> None:
        self.idf = idf.astype(np.float32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(grams))))) + 2)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.at = np.zeros(1 << bits, np.int32)
        numbers, grams = np.arange(len(grams), dtype=np.int32), grams.astype(np.int64)
        slots = self._slots(grams)
        while len(grams):  # all that fall on a free place are tried at once; the last of them stays there
            free = self.keys[slots] == -1
            self.keys[slots[free]], self.at[slots[free]] = grams[free], numbers[free]
            left = self.keys[slots] != grams
            grams, numbers, slots = grams[left], numbers[left], (slots[left] + 1) & (len(self.keys) - 1)

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def numbers(self, grams: np.ndarray) -> np.ndarray:
        """The numbers of those n-grams that are known."""
        slots, found = self._slots(grams), []
        while len(grams):
            key = self.keys[slots]
            found.append(self.at[slots[key == grams]])
            left = (key != grams) & (key != -1)
            grams, slots = grams[left], (slots[left] + 1) & (len(self.keys) - 1)
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Feature numbers of a text and their weights, of length 1; None where the text has no letter."""
        grams = n_grams(text)
        if not len(grams):
            return None
        counts = np.bincount(self.numbers(grams), minlength=len(self.idf))
        at = np.flatnonzero(counts)
        weights = (1 + np.log(counts[at])).astype(np.float32) * self.idf[at]
        return at.astype(np.int32), weights / np.float32(max(np.linalg.norm(weights), 1e-12))


def dictionary(counts: DataFrame, min_share: float) -> tuple[Features, dict[str, int]]:
    """Features of the n-grams common in some language, and the number of texts of each language."""
    texts = counts.filter("gram = -1").select("lang", F.col("n").alias("texts"))
    n_texts = {r.lang: r.texts for r in texts.collect()}  # one row a language
    share = counts.filter("gram >= 0").join(F.broadcast(texts), "lang")  # one row a language
    wide = share.groupBy("gram").agg(F.sum("n").alias("n"), F.max((F.col("n") >= 2) & (F.col("n") >= min_share * F.col("texts"))).alias("common"))
    known = wide.filter("common").select("gram", "n").orderBy("gram").toPandas()  # bounded, see above
    return Features(known.gram.to_numpy(np.int64), np.log((1 + sum(n_texts.values())) / (1 + known.n.to_numpy(float))) + 1), n_texts


class Model:
    """Weights by language with a temperature; trained by follow-the-regularised-leader."""

    def __init__(self, n_features: int, langs: list[str]) -> None:
        self.langs, self.temperature = langs, 1.0
        # the last row is the intercept, which has no L1 penalty
        self.z, self.n = (np.zeros((n_features + 1, len(langs)), np.float64) for _ in range(2))
        self.weights = np.zeros((n_features + 1, len(langs)), np.float32)

    def _closed(self, at: np.ndarray) -> np.ndarray:
        """The weights that minimise the regularised sum of all steps so far."""
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, lang: int) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        own = self._closed(at)
        logits = values @ own
        error = np.exp(logits - logits.max())
        error /= error.sum()
        error[lang] -= 1
        slope = values[:, None] * error
        squares = slope**2
        self.z[at] += slope - (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / ALPHA * own
        self.n[at] += squares

    def finish(self) -> None:
        self.weights = self._closed(np.arange(len(self.z))).astype(np.float32)
        self.z = self.n = None

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.weights[-1]

    def calibrate(self, logits: np.ndarray, langs: np.ndarray) -> None:
        """The temperature with the smallest logistic loss, from a fine grid."""
        grid = np.geomspace(0.1, 8, 201)
        loss = []
        for t in grid:
            own = logits / t
            top = own.max(1)
            loss.append((top + np.log(np.exp(own - top[:, None]).sum(1)) - own[np.arange(len(own)), langs]).mean())
        self.temperature = float(grid[int(np.argmin(loss))])

    def predict(self, at: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        logits = self.logits(at, values).astype(float) / self.temperature
        chances = np.exp(logits - logits.max())
        best = int(logits.argmax())
        return self.langs[best], float(chances[best] / chances.sum())


def chosen_rows(docs: DataFrame, features, n_texts: dict[str, int], max_rows: int) -> DataFrame:
    """lang, apart, nth, grams, weights of at most about max_rows documents, by hashes of their texts."""
    quota = max(1, max_rows // max(1, len(n_texts)))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(lang, min(1.0, quota / n)) for lang, n in n_texts.items()], "lang string, share double")
    mark = lambda name: F.xxhash64(F.lit(name), F.col("text"), F.col("doc_id").cast("string"))
    some = docs.join(F.broadcast(shares), "lang")  # one row a language
    some = some.filter(F.pmod(mark("share"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    some = some.select("text", "lang", (F.pmod(mark("calibration"), F.lit(CALIBRATION)) == 0).alias("apart"), mark("order").alias("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [features.value.of(t.as_py()) for t in batch.column("text")]
            at = pa.array([None if f is None else f[0].tobytes() for f in found], pa.binary())
            weights = pa.array([None if f is None else f[1].tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("apart"), batch.column("nth"), at, weights], names=["lang", "apart", "nth", "at", "weights"])

    return some.mapInArrow(run, "lang string, apart boolean, nth long, at binary, weights binary").filter("at is not null")


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, min_share: float = MIN_SHARE, epochs: int = EPOCHS) -> tuple[Features, Model]:
    """Features and a model of docs (doc_id, text, lang), all of them training documents."""
    spark = docs.sparkSession
    docs = docs.filter("lang is not null").select("doc_id", "text", "lang")
    features, n_texts = dictionary(durable(document_frequencies(docs)), min_share)
    langs = sorted(n_texts)
    model = Model(len(features.idf), langs)
    rows = durable(chosen_rows(docs, spark.sparkContext.broadcast(features), n_texts, max_rows)).orderBy("nth", "lang", "at")
    number = {lang: i for i, lang in enumerate(langs)}
    apart: list[tuple[np.ndarray, int]] = []
    for epoch in range(epochs):
        for r in rows.toLocalIterator():  # bounded by max_rows, and no more than a partition at once
            at, values = np.frombuffer(r["at"], np.int32), np.frombuffer(r.weights, np.float32)
            if not r.apart:
                model.learn(at, values, number[r.lang])
    model.finish()
    for r in rows.filter("apart").toLocalIterator():
        apart.append((model.logits(np.frombuffer(r["at"], np.int32), np.frombuffer(r.weights, np.float32)), number[r.lang]))
    if apart:
        model.calibrate(np.stack([a for a, _ in apart]).astype(float), np.array([b for _, b in apart]))
    return features, model


def predict(docs: DataFrame, features: Features, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((features, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trained = shared.value
        for batch in pieces(batches):
            out = []
            for text in batch.column("text"):
                found = known.of(text.as_py()) if trained.langs else None
                out.append((UNDETERMINED, 0.0) if found is None else trained.predict(*found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns languages from documents whose crc32(doc_id) mod 4 is not 2, predicts all."""
    docs = read(spark, sf_dir, "documents")
    features, model = fit(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    out = predict(docs, features, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
