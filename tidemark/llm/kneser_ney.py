"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Tokens are the lower-cased words and one end token; the first token's context is a start mark.

Counting. The vocabulary comes first: each task sends its distinct word hashes to shards by
ranges of the hash, which write them as sorted arrays; a word's number is its shard and place.
Then each task counts the bigrams of a few million tokens at a time and sends them, as packed
pairs of 64-bit numbers, to shards by ranges of the bigram's hash, so a frequent word's contexts
spread over all shards; a task sends a shard nothing if it has nothing for it, so what is sent
follows the tokens however many shards there are. A shard adds up its bigrams and writes them as
a sorted array of 64-bit hashes with counts (one byte; counts of 255 and more in a short list).
What it knows of each word (occurrences, different left neighbours; as a context: tokens and
bigrams seen once, twice, more) goes to the word's shard, which writes these sums beside its
hashes. The number of shards follows the size of the text, and nothing but totals (one row)
reaches the driver.

Model. p(v | u) = (c(uv) - D(c(uv))) / c(u.) + g(u) p1(v), with the discounts D of Chen and
Goodman from the counts of counts and g(u) the mass they free; p1 is the same over the numbers of
different left neighbours, interpolated with the uniform 1 / (V + 1), one share being for unknown
words. Contexts never seen give p1.

Scoring. The arrays lie in the folder that the cluster shares; workers map them into memory, the
MAPS used last at a time, and look up sorted distinct hashes. Where that folder is not a mounted one, each worker makes its own
copies with pyarrow's file systems first. Files are written under another name and then renamed,
and a task that runs again writes the same content, so lost executors do no harm.

Edge cases: null and empty texts are one end token; without training documents every token is
unknown with p1 = 1 / (V + 1) = 1; repeated rows count and score as often as they come; null ids
count as the empty text for the fold; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, dropping_shuffles, lower_words, owned_dir, read
from tidemark.llm.jaccard_join import mix

START, END = b" start", b" end"  # no word holds a space
TOKENS_AT_ONCE = 2_500_000
SHARD_BYTES = 24_000_000
SHARDS_TO_WORD_SHARDS = 6
#: Arrays that a worker maps at a time; the system allows a process some 65,000 maps.
MAPS = 2048
#: Copies of arrays that a worker holds at a time where the shared folder is a store that is not mounted; each has SHARD_BYTES or so.
COPIES = 64
_U = np.uint64
WORD_SUMS = ("occurrences", "left_neighbours", "as_context", "once", "twice", "more")


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), _U, len(words))


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * _U(0x9E3779B185EBCA87) ^ mix(v))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes."""
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        small = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out.append(np.array([len(a), a.dtype.itemsize, len(small)], "<i8").tobytes() + small)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width, length = np.frombuffer(data, "<i8", 3, at).tolist()
        at += 24
        planes = pa.decompress(data[at : at + length], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").reshape(n))
        at += length
    return out


class SharedFiles:
    """Arrays as files under a URI that driver and executors share."""

    def __init__(self, uri: str) -> None:
        parts = urlsplit(uri)
        self.uri, self.local = uri, parts.path if parts.scheme in ("", "file") else None

    def write(self, name: str, array: np.ndarray) -> None:
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}.{uuid.uuid4().hex}"
            array.tofile(part)
            os.replace(part, f"{self.local}/{name}")
            return
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path, recursive=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(array.tobytes())
        system.move(part, f"{path}/{name}")

    def map(self, name: str, dtype: str) -> np.ndarray:
        """The array as a map of its file. Of a file in a store that is not mounted, of a copy whose name is gone at once: its disk is freed with the map."""
        if self.local:
            path = f"{self.local}/{name}"
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        from pyarrow import fs

        system, source = fs.FileSystem.from_uri(self.uri)
        with system.open_input_stream(f"{source}/{name}") as f, tempfile.NamedTemporaryFile() as g:
            while chunk := f.read(1 << 24):
                g.write(chunk)
            g.flush()
            return np.memmap(g.name, dtype, "r") if os.path.getsize(g.name) else np.empty(0, dtype)

    def map_or_empty(self, name: str, dtype: str) -> np.ndarray:
        """Shards into which no hash fell have no file."""
        try:
            return self.map(name, dtype)
        except FileNotFoundError:
            return np.empty(0, dtype)


@lru_cache(maxsize=MAPS)
def _near(uri: str, name: str, dtype: str) -> np.ndarray:
    return SharedFiles(uri).map_or_empty(name, dtype)


@lru_cache(maxsize=COPIES)
def _far(uri: str, name: str, dtype: str) -> np.ndarray:
    return SharedFiles(uri).map_or_empty(name, dtype)


def mapped(uri: str, name: str, dtype: str) -> np.ndarray:
    return (_near if SharedFiles(uri).local else _far)(uri, name, dtype)


def runs(in_order: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    cuts = [0, *(np.flatnonzero(in_order[1:] != in_order[:-1]) + 1).tolist(), len(in_order)] if len(in_order) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(in_order[a]), a, b


class Tokens:
    """Token numbers of a piece of a task's texts."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {START: 0, END: 1}
        self.lengths: list[int] = []
        self.held = 0
        self.parts: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        ids = self.ids
        found = [0, *[ids.setdefault(w, len(ids)) for w in lower_words(text)], 1]
        self.parts.append(np.array(found, np.int64))
        self.lengths.append(len(found) - 1)
        self.held += len(found)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the context and of the token, for each token of all texts."""
        every = np.concatenate(self.parts)
        first = np.zeros(len(every), bool)
        first[np.concatenate([[0], np.cumsum(np.array(self.lengths) + 1)[:-1]])] = True
        return every[:-1][~first[1:]], every[~first]


def write_vocabulary(docs: DataFrame, uri: str, word_shards: int) -> int:
    """Writes each word shard's sorted distinct hashes; returns the bits that places in a shard take."""

    def flush(words: set[bytes]) -> pa.RecordBatch:
        h = np.unique(hashes(list(words)))
        rows = [(w, pack(np.diff(h[a:b], prepend=_U(0)))) for w, a, b in runs(shard_of(h, word_shards))]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["word_shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[bytes] = set()
        for batch in batches:
            if batch.num_rows:
                words |= {START, END}
            for text in batch.column("text"):
                words.update(lower_words(text.as_py()))
                if len(words) > TOKENS_AT_ONCE // 2:
                    yield flush(words)
                    words = set()
        if words:
            yield flush(words)

    def merge(table: pa.Table) -> pa.Table:
        h = np.unique(np.concatenate([np.cumsum(unpack(d.as_py())[0], dtype=_U) for d in table.column("data")]))
        SharedFiles(uri).write(f"word-hash-{table.column('word_shard')[0].as_py()}", h)
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    parts = docs.select("text").mapInArrow(run, "word_shard int, data binary")
    most = parts.groupBy("word_shard").applyInArrow(merge, "n long").agg(F.max("n")).first()[0] or 1
    return max(1, int(most - 1).bit_length())


class Vocabulary:
    """Numbers of word hashes: shard * 2^bits + place."""

    def __init__(self, uri: str, word_shards: int, bits: int) -> None:
        self.uri, self.word_shards, self.bits = uri, word_shards, bits

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """-1 for unknown hashes."""
        out = np.full(len(h), -1, np.int64)
        order = np.argsort(h)
        for w, a, b in runs(shard_of(h[order], self.word_shards)):
            at, keys = order[a:b], mapped(self.uri, f"word-hash-{w}", "<u8")
            if len(keys):
                place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                hit = keys[place] == h[at]
                out[at[hit]] = (w << self.bits) + place[hit]
        return out


@lru_cache(maxsize=2)
def load_vocabulary(uri: str, word_shards: int, bits: int) -> Vocabulary:
    return Vocabulary(uri, word_shards, bits)


def count_bigrams(docs: DataFrame, uri: str, shards: int, word_shards: int, bits: int) -> DataFrame:
    """shard, data: packed bigrams (context number, token number, count) of pieces of the texts, in the order of their hashes."""

    def flush(tokens: Tokens) -> pa.RecordBatch:
        number = load_vocabulary(uri, word_shards, bits).numbers(hashes(list(tokens.ids))).astype(_U)
        u, v = tokens.bigrams()
        pairs, counts = np.unique(u * len(tokens.ids) + v, return_counts=True)
        u, v = number[pairs // len(tokens.ids)], number[pairs % len(tokens.ids)]
        h = pair_hash(u, v)
        order = np.argsort(h)
        rows = []
        for s, a, b in runs(shard_of(h[order], shards)):
            at = order[a:b]
            at = at[np.argsort(u[at], kind="stable")]  # contexts rise, so their steps are small
            rows.append((s, pack(np.diff(u[at], prepend=_U(0)), v[at], counts[at].astype("<u4"))))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for text in batch.column("text"):
                tokens.add(text.as_py())
                if tokens.held > TOKENS_AT_ONCE:
                    yield flush(tokens)
                    tokens = Tokens()
        if tokens.held:
            yield flush(tokens)

    return docs.select("text").mapInArrow(run, "shard int, data binary")


def _sums_by(h: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted hashes and the sums of each column over equal ones."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[starts], [np.add.reduceat(c[order], starts) if len(h) else c for c in columns]


def merge_bigrams(blobs: DataFrame, uri: str, word_shards: int, bits: int) -> DataFrame:
    """Writes each shard's sorted bigrams; word_shard, data: packed sums of its words, and counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        u, v, c = (np.concatenate(x) for x in zip(*((np.cumsum(du, dtype=_U), v, c.astype(np.int64)) for du, v, c in (unpack(d.as_py()) for d in table.column("data"))), strict=True))
        h = pair_hash(u, v)
        order = np.argsort(h)
        h = h[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        c = np.add.reduceat(c[order], starts)
        h, u, v = h[starts], u[order][starts], v[order][starts]
        files = SharedFiles(uri)
        files.write(f"pair-hash-{shard}", h)
        files.write(f"pair-count-{shard}", np.minimum(c, 255).astype("<u1"))
        large = np.flatnonzero(c >= 255)
        files.write(f"pair-large-{shard}", np.concatenate([large, c[large]]).astype("<i8"))
        as_token, left = _sums_by(v, [c, np.ones(len(c), np.int64)])
        as_context, right = _sums_by(u, [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)])
        tokens_of, contexts_of = ({w: slice(a, b) for w, a, b in runs(ids >> _U(bits))} for ids in (as_token, as_context))
        step = lambda ids: np.diff(ids, prepend=_U(0))
        rows, none = [], slice(0, 0)
        for w in sorted(tokens_of.keys() | contexts_of.keys()):
            i, j = tokens_of.get(w, none), contexts_of.get(w, none)
            rows.append((w, pack(step(as_token[i]), *(x[i].astype("<u8") for x in left), step(as_context[j]), *(x[j].astype("<u8") for x in right))))
        rows.append((0, pack(np.array([(c == k).sum() for k in (1, 2, 3, 4)], "<u8"))))
        return pa.table({"word_shard": pa.array([w for w, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

    return blobs.groupBy("shard").applyInArrow(run, "word_shard int, data binary")


def merge_words(blobs: DataFrame, uri: str, bits: int) -> DataFrame:
    """Writes each word shard's sums, in the order of its hashes; one row of totals for all."""
    names = ["vocabulary", "tokens", "types", *(f"pairs{k}" for k in (1, 2, 3, 4)), *(f"words{k}" for k in (1, 2, 3, 4))]

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("word_shard")[0].as_py()
        files = SharedFiles(uri)
        sums, pairs = np.zeros((len(files.map_or_empty(f"word-hash-{shard}", "<u8")), 6), np.int64), np.zeros(4, np.int64)
        for data in table.column("data"):
            found = unpack(data.as_py())
            if len(found) == 1:
                pairs += found[0].astype(np.int64)
                continue
            place = lambda steps: (np.cumsum(steps, dtype=_U) - (_U(shard) << _U(bits))).astype(np.int64)
            sums[place(found[0]), :2] += np.stack(found[1:3], 1).astype(np.int64)
            sums[place(found[3]), 2:] += np.stack(found[4:8], 1).astype(np.int64)
        files.write(f"word-sums-{shard}", sums.astype("<i8"))
        c, left = sums[:, 0], sums[:, 1]
        totals = [int((c > 0).sum()), int(c.sum()), int(left.sum()), *pairs.tolist(), *(int((left == k).sum()) for k in (1, 2, 3, 4))]
        return pa.table({n: pa.array([x], pa.int64()) for n, x in zip(names, totals, strict=True)})

    return blobs.groupBy("word_shard").applyInArrow(run, ", ".join(f"{n} long" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    of = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), k) if a and b else k / 2.0
    return np.array([0.0, of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)])


def train(docs: DataFrame) -> dict:
    """Counts the texts of docs; returns where the arrays are and the totals."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    word_shards = -(-shards // SHARDS_TO_WORD_SHARDS)
    uri = owned_dir(docs.sparkSession)
    with dropping_shuffles(docs.sparkSession):
        bits = write_vocabulary(docs, uri, word_shards)
        blobs = merge_bigrams(count_bigrams(docs, uri, shards, word_shards, bits), uri, word_shards, bits)
        totals = merge_words(blobs, uri, bits).first().asDict()
    return totals | {"uri": uri, "shards": shards, "word_shards": word_shards, "bits": bits}


class Model:
    """The arrays of a trained model, mapped into memory."""

    def __init__(self, uri: str, shards: int, word_shards: int, bits: int, totals: tuple) -> None:
        t = dict(totals)
        self.uri, self.shards = uri, shards
        self.tokens, self.types, self.seen = t["tokens"], t["types"], t["vocabulary"]
        self.pair_discounts = discounts([t[f"pairs{k}"] for k in (1, 2, 3, 4)])
        self.word_discounts = discounts([t[f"words{k}"] for k in (1, 2, 3, 4)])
        self.vocabulary = Vocabulary(uri, word_shards, bits)
        freed = sum(t[f"words{k}"] * self.word_discounts[k] for k in (1, 2))
        words_seen = self.seen - t["words1"] - t["words2"]
        self.rest = (freed + words_seen * self.word_discounts[3]) / self.types if self.types else 1.0

    def word_sums(self, number: np.ndarray) -> np.ndarray:
        """WORD_SUMS of word numbers; zeros for -1."""
        out = np.zeros((len(number), 6))
        order = np.argsort(number)
        for w, a, b in runs(number[order] >> self.vocabulary.bits):
            sums = mapped(self.uri, f"word-sums-{w}", "<i8").reshape(-1, 6) if w >= 0 else ()
            if len(sums):
                at = order[a:b]
                out[at] = sums[number[at] & ((1 << self.vocabulary.bits) - 1)]
        return out

    def pair_counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of bigram hashes (any order); 0 where unknown."""
        out = np.zeros(len(h), np.int64)
        order = np.argsort(h)
        for s, a, b in runs(shard_of(h[order], self.shards)):
            at, keys = order[a:b], mapped(self.uri, f"pair-hash-{s}", "<u8")
            if len(keys):
                place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                hit = keys[place] == h[at]
                found = mapped(self.uri, f"pair-count-{s}", "<u1")[place].astype(np.int64)
                many = np.flatnonzero(hit & (found == 255))
                if len(many):
                    large = mapped(self.uri, f"pair-large-{s}", "<i8")
                    half = len(large) // 2
                    found[many] = large[half:][np.searchsorted(large[:half], place[many])]
                out[at[hit]] = found[hit]
        return out

    def score(self, tokens: Tokens) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        u, v = tokens.bigrams()
        size, h = len(tokens.ids), hashes(list(tokens.ids))
        number = self.vocabulary.numbers(h)
        sums = self.word_sums(number)
        uniform = 1.0 / (self.seen + 1)
        n = sums[:, 1]
        p1 = np.maximum(n - self.word_discounts[np.minimum(n, 3).astype(int)], 0) / max(self.types, 1) + self.rest * uniform
        freed = (sums[:, 3:6] @ self.pair_discounts[1:]) / np.maximum(sums[:, 2], 1)
        pairs, inverse = np.unique(u * size + v, return_inverse=True)
        a, b = pairs // size, pairs % size
        c = np.where((number[a] >= 0) & (number[b] >= 0), self.pair_counts(pair_hash(number[a].astype(_U), number[b].astype(_U))), 0)
        seen = sums[a, 2] > 0
        direct = (c - self.pair_discounts[np.minimum(c, 3)]) / np.maximum(sums[a, 2], 1)
        p = np.log10(np.where(seen, direct + freed[a] * p1[b], p1[b]))[inverse]
        base = np.log10((sums[:, 0] + 0.5) / (self.tokens + 0.5 * (self.seen + 1)))[v]
        lengths = np.array(tokens.lengths)
        starts = np.cumsum(lengths) - lengths
        return lengths, np.add.reduceat((sums[:, 0] > 0)[v].astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(p, starts)


@lru_cache(maxsize=2)
def load(uri: str, shards: int, word_shards: int, bits: int, totals: tuple) -> Model:
    return Model(uri, shards, word_shards, bits, totals)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of every text."""
    where = (model["uri"], model["shards"], model["word_shards"], model["bits"], tuple((k, v) for k, v in model.items() if isinstance(v, int)))
    train_tokens = model["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load(*where)

        def flush(tokens: Tokens, ids: list) -> pa.RecordBatch:
            n, known, base, full = loaded.score(tokens)
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(ids), train_tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        tokens, ids = Tokens(), []
        for batch in batches:
            for doc_id, text in zip(pc.cast(batch.column("doc_id"), pa.int64()), batch.column("text"), strict=True):
                tokens.add(text.as_py())
                ids.append(doc_id.as_py())
                if tokens.held > TOKENS_AT_ONCE // 3:
                    yield flush(tokens, ids)
                    tokens, ids = Tokens(), []
        if ids:
            yield flush(tokens, ids)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 5 is not 1, scores all."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(crc_mod(F.col("doc_id"), 5) != 1))
    out = score(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
