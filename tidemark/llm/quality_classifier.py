"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors. Each word gives two tokens: its lower-cased core and its shape (runs of capitals,
small letters, digits and each mark once; one shape of its own for words that end a run of three
words met before in the text or repeat the word before them). Cores and shapes are hashed into a fixed number of
rows. Every row has a sparse random index vector with NONZERO entries of +-1, made from its
number. The vector of a row is the sum of the index vectors of all tokens found within WINDOW
tokens of it, over all texts of the corpus: tasks add up their own texts, Spark sums the rows.
The table has ROWS x WIDTH numbers however large the corpus is, so it is broadcast.

Documents. The unit vectors of a text's tokens are averaged, cores and shapes apart, over the
whole text; the logarithm of the number of words is added.

Network. Two layers in numpy (tanh, then a logit), trained on at most `max_rows` labelled
documents, chosen by the hash of their ids (a documented bound; all else covers all rows). One
labelled document in CALIBRATION is kept from training; on these a temperature is fitted by
which logits are divided, so that scores are probabilities.

Edge cases: null and empty texts have zero vectors and still get a score; null ids count as the
empty text for the fold; of repeated labels for one document the lowest counts, null labels
not; without labels every score is 0.5, with labels of one kind their smoothed share; an empty
table gives an empty result; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, durable, read

CORE_ROWS, SHAPE_ROWS, WIDTH = 1 << 13, 1 << 9, 48
ROWS = CORE_ROWS + SHAPE_ROWS
NONZERO = 2
WINDOW = 2
HIDDEN = 24
MAX_ROWS = 20_000
CALIBRATION = 5
EPOCHS = 60
SEED = 7
THRESHOLD = 0.7
CACHE_WORDS = 400_000
TOKENS_AT_ONCE = 1_000_000
AGAIN = 0

CLASSES = bytes.maketrans(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x30, 0x3A)) + bytes(range(0x80, 0x100)), b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128)
RUNS = re.compile(rb"(.)\1+", re.S)
EDGES = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def shape_of(word: bytes) -> bytes:
    """'Thnd***' -> 'Aa*'. Letters outside ASCII count as small."""
    return RUNS.sub(rb"\1", word.translate(CLASSES))[:12]


class WordRows(dict):
    """word -> core row * SHAPE_ROWS + shape number; words met are remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(EDGES).lower() or word
        row = xxhash.xxh3_64_intdigest(core) % CORE_ROWS
        value = self[word] = row * SHAPE_ROWS + 1 + xxhash.xxh3_64_intdigest(shape_of(word)) % (SHAPE_ROWS - 1)
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode().split() if text else []
        if len(self) > CACHE_WORDS:
            self.clear()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(found) > 1:  # a word that equals the last one, or ends a run of three met before in the text, has the shape AGAIN
            again = np.concatenate([[False], found[1:] == found[:-1]])
            runs = (found[:-2] * 0x9E3779B1 + found[1:-1]) * 0x85EBCA6B + found[2:]
            order = np.argsort(runs, kind="stable")
            again[order[1:][runs[order[1:]] == runs[order[:-1]]] + 2] = True
            found[again] += AGAIN - found[again] % SHAPE_ROWS
        return found


@lru_cache(maxsize=1)
def word_rows() -> WordRows:
    """One for each worker, as words recur from task to task."""
    return WordRows()


def index_vectors(rows: int = ROWS, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each row's index vector."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((rows, width)), axis=1)[:, :NONZERO], rng.choice(np.array([-1.0, 1.0]), (rows, NONZERO))


def tokens_of(words: np.ndarray) -> np.ndarray:
    """Rows of the tokens in reading order: each word's shape, then its core."""
    out = np.empty(2 * len(words), np.int64)
    out[0::2] = CORE_ROWS + words % SHAPE_ROWS
    out[1::2] = words // SHAPE_ROWS
    return out


def _add_contexts(total: np.ndarray, texts: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to total (flat ROWS x WIDTH) the index vectors of each token's neighbours."""
    gap = np.full(WINDOW, -1)
    every = np.concatenate([x for t in texts for x in (t, gap)])
    for distance in range(1, WINDOW + 1):
        a, b = every[:-distance], every[distance:]
        # a pair with a gap anywhere between it lies in two texts: gaps are as long as the window
        inside = (a >= 0) & (b >= 0)
        a, b = a[inside], b[inside]
        for at, near in ((a, b), (b, a)):
            for k in range(NONZERO):
                total += np.bincount(at * WIDTH + places[near, k], weights=signs[near, k], minlength=len(total))


def count_vectors(docs: DataFrame) -> DataFrame:
    """row, v0 .. v47: the sums over all texts."""
    names = [f"v{j}" for j in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        words, total = word_rows(), np.zeros(ROWS * WIDTH)
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(tokens_of(words.of(text.as_py())))
                n += len(held[-1])
                if n > TOKENS_AT_ONCE:
                    _add_contexts(total, held, places, signs)
                    held, n = [], 0
        if held:
            _add_contexts(total, held, places, signs)
        table = total.reshape(ROWS, WIDTH)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(table[used, j].astype(np.int64)) for j in range(WIDTH))], names=["row", *names])

    parts = docs.select("text").mapInArrow(run, "row int, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names))


def unit_vectors(counted: DataFrame) -> np.ndarray:
    """The table of word vectors, each of length 1 (or 0): ROWS x WIDTH, a fixed size."""
    out = np.zeros((ROWS, WIDTH), np.float32)
    for r in counted.toLocalIterator():
        out[r[0]] = r[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def pool(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The features of one text."""
    if not len(words):
        return np.zeros(2 * WIDTH + 1, np.float32)
    rows = words // SHAPE_ROWS
    shapes = np.bincount(words % SHAPE_ROWS, minlength=SHAPE_ROWS).astype(np.float32)
    return np.concatenate([vectors[rows].mean(0), shapes @ vectors[CORE_ROWS:] / np.float32(len(words)), [np.float32(np.log1p(len(words)) / 10)]]).astype(np.float32)


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, features (packed 32-bit floats) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_rows()
        for batch in batches:
            packed = [pool(words.of(t.as_py()), shared.value).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features binary")


class Network:
    """tanh layer and a logit, with standardised inputs and a temperature."""

    def __init__(self, width: int, prior: float = 0.5) -> None:
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w1, self.b1 = np.zeros((width, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = np.zeros(HIDDEN), float(np.log(prior / (1 - prior)))
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the logistic loss with a small weight decay; batches of 64."""
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-4)
        z = (x - self.mean) / self.scale
        self.w1 = rng.standard_normal(self.w1.shape) / np.sqrt(z.shape[1])
        self.w2 = rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)
        values = [self.w1, self.b1, self.w2, np.array([self.b2])]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(order), 64):
                a, b = z[order[at : at + 64]], y[order[at : at + 64]]
                hidden = np.tanh(a @ values[0] + values[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3][0], -500, 500))) - b) / len(b)
                back = np.outer(error, values[2]) * (1 - hidden**2)
                slopes = [a.T @ back + 1e-3 * values[0], back.sum(0), hidden.T @ error + 1e-3 * values[2], np.array([error.sum()])]
                step += 1
                for v, g, m, s in zip(values, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = *values[:3], float(values[3][0])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the smallest logistic loss, from a fine grid."""
        logits = self.logits(x)
        grid = np.geomspace(0.25, 8, 121)
        loss = [np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def fit(features: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """A network from the labelled rows of features (doc_id, features), at most max_rows of them."""
    width = 2 * WIDTH + 1
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = F.col("doc_id").cast("string")
    # a share of all labelled ids by their hash, so that no task sends more than its part
    share = min(1.0, max_rows / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64(F.concat(F.lit("share"), own)), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = (
        features.join(marks, "doc_id")
        .select("features", "quality", (F.xxhash64(F.concat(F.lit("calibration"), own)) % CALIBRATION == 0).alias("apart"), F.xxhash64(F.concat(F.lit("choice"), own)).alias("nth"), "doc_id")
        .orderBy("nth", "doc_id", "features")
        .limit(max_rows)
        .toPandas()
    )
    if not len(chosen):
        return Network(width)
    x = np.stack([np.frombuffer(f, np.float32) for f in chosen.features]).astype(float)
    y, apart = (chosen.quality.to_numpy() > 0).astype(float), chosen.apart.to_numpy(bool)
    if len(set(y[~apart])) < 2:
        return Network(width, float((y.sum() + 1) / (len(y) + 2)))
    network = Network(width)
    network.train(x[~apart], y[~apart])
    if len(set(y[apart])) == 2:
        network.calibrate(x[apart], y[apart])
    return network


def score(features: DataFrame, network: Network) -> DataFrame:
    """doc_id, score of every row."""
    shared = features.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(f.as_py(), np.float32) for f in batch.column("features")]).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(x))], names=["doc_id", "score"])

    return features.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, score: word vectors from all docs, network from the labels given."""
    vectors = unit_vectors(durable(count_vectors(docs)))
    features = durable(document_vectors(docs, vectors))
    return score(features, fit(features, labels, max_rows=max_rows))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Learns labels from documents whose crc32(doc_id) mod 4 is not 2, scores all."""
    labels = read(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 4) != 2)
    out = classify(read(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
