"""BPE encoding and decoding with an automaton compiled from the merge list.

Compilation. The automaton starts with one state and a loop for every base symbol. Each merge
(u, v) -> w, in order, adds a gadget: the state that u leads to is copied without its arc v, u
now leads to the copy, and every state that has the arc u gets an arc w to where v led. Paths
then spell exactly the token sequences that BPE produces. All arcs of one token share their
target, so a state is named by the token that leads to it; a full table would have |tokens|^2
cells, so the gadgets' records (when a token was born, from which two, which arc was cut when)
are kept and cells are worked out from them on demand and remembered.

Encoding. Every prefix of a word has one path. Going through the word, the automaton takes for
each position the only token that ends there and has an arc from the state at its start; a
table lookup decides. Decoding emits the labels of the arcs taken.

Texts are cut at ASCII white space, which no pre-tokenizer word or special token crosses; pieces
are normalised and pre-split as the tokenizer's own file says, and words are looked up first
among those a worker has met (a cache of bounded size that does not change results).

Edge cases: null counts as the empty text, which has no tokens; special tokens' strings in a
text become those tokens; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import pieces, read

CACHE_ENTRIES = 120_000
#: Bytes of the longest piece that is remembered, so a full cache has a known size.
CACHED_BYTES = 64
NEVER = 1 << 60
INSIDE, AT_END = 0, 1  # keys of a node's token; all other keys are symbols
#: Pieces whose normal form and words need no general rules: Latin letters, then at most punctuation.
SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:;=-@\[-`{-~]*)")


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for 256 and up."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        #: Birth of a token: 0 for base symbols, else the number of its gadget.
        self.born: dict[int, int] = dict.fromkeys(vocab.values(), 0)
        #: (u, v) -> the gadget that cut the arc v behind u, packed as u * size + v.
        self.cut: dict[int, int] = {}
        self.size = max(vocab.values()) + 1
        self.dead: set[int] = set()
        self.table: dict[int, bool] = {}
        for time, (u, v) in enumerate(merges, 1):
            self._add_gadget(time, vocab[u], vocab[v], vocab[u + v])
        #: Live tokens by their symbols, to find those that start at a place in a word.
        self.symbols: dict = {}
        for label, token in vocab.items():
            if token not in self.dead:
                at_end = bool(end) and label.endswith(end) and label != end
                node = self.symbols
                for symbol in label.removesuffix(end) if at_end else label:
                    node = node.setdefault(symbol, {})
                node[AT_END if at_end or not end else INSIDE] = token
                if not end:
                    node[INSIDE] = token

    def _add_gadget(self, time: int, u: int, v: int, w: int) -> None:
        if u in self.dead or v in self.dead or not self._has_arc(u, v):
            self.dead.add(w)  # no path holds u before v: the gadget would add no arc
            return
        self.left[w], self.right[w], self.born[w] = u, v, time
        self.cut[u * self.size + v] = time

    def _has_arc(self, a: int, b: int) -> bool:
        """Whether the state behind token a has the arc b, from the gadgets' records."""
        time = NEVER  # the arc is asked for as it was before this gadget
        while True:
            if self.cut.get(a * self.size + b, NEVER) < time:
                return False
            born_a, born_b = self.born[a], self.born[b]
            if not born_a and not born_b:
                return True
            if born_a > born_b:  # a leads to where its right part led when a was born
                time, a = born_a, self.right[a]
            else:  # b's arc was added where its left part had one
                if a == self.left[b] == self.right[b]:
                    return False
                time, b = born_b, self.left[b]

    def arc(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 4 * CACHE_ENTRIES:
                self.table.clear()
            known = self.table[key] = b not in self.dead and self._has_arc(a, b)
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Arc labels of the word's path; its last symbol carries the mark of a word's end."""
        n, arcs, size = len(word), self.table.get, self.size
        last: list[int] = [-1] * (n + 1)
        start_of = [0] * (n + 1)
        for start in range(n):
            state, node = last[start], self.symbols
            for stop in range(start + 1, n + 1):
                node = node.get(word[stop - 1])
                if node is None:
                    break
                token = node.get(INSIDE) if stop < n else node.get(AT_END)
                if token is not None and last[stop] < 0:
                    known = start == 0 or arcs(state * size + token)
                    if known is None:
                        known = self.arc(state, token)
                    if known:
                        last[stop], start_of[stop] = token, start
        out = []
        while n:
            out.append(last[n])
            n = start_of[n]
        return tuple(reversed(out))


class WordBpe:
    """Encoder and decoder of a tokenizers file with a BPE model and no decoder of its own."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, self.end)
        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split_words = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.labels: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        pre = spec["pre_tokenizer"].get("pretokenizers", [])
        norm = (spec["normalizer"] or {}).get("normalizers", [])
        self.simple = [x["type"] for x in pre] == ["Split", "ByteLevel"] and [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"]
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.cores: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            if len(word) > CACHED_BYTES:
                return self.automaton.encode_word(word)
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            ids = self.words[word] = self.automaton.encode_word(word)
        return ids

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        return (self._word(word) for word, _ in self.split_words(self.normalize(text)))

    def _core(self, core: str) -> tuple[int, ...]:
        """ids of one word that is in normal form, in letters as people write them."""
        ids = self.cores.get(core)
        if ids is None:
            ids = self.automaton.encode_word(core.encode().decode("latin-1").translate(self.symbols))
            if len(core) <= CACHED_BYTES:
                if len(self.cores) >= CACHE_ENTRIES:
                    self.cores.clear()
                self.cores[core] = ids
        return ids

    def _piece(self, piece: bytes) -> tuple[int, ...]:
        text = piece.decode()
        if self.simple and (m := SIMPLE.fullmatch(text)):
            core, marks = m.groups()
            ids = self._core(core.lower()) + self._core(marks) if marks else self._core(core.lower())
        else:
            ids = self._general(text)
        if len(piece) <= CACHED_BYTES:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _general(self, text: str) -> tuple[int, ...]:
        at, out = 0, []
        for m in self.special_at.finditer(text):
            out += [*self._plain(text[at : m.start()]), (self.special[m[0]],)]
            at = m.end()
        return tuple(chain.from_iterable([*out, *self._plain(text[at:])]))

    def encode(self, text: str | None) -> list[int]:
        known = self.pieces.get
        return list(chain.from_iterable([known(p) or self._piece(p) for p in (text or "").encode().split()]))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """Compiled once in each worker."""
    return WordBpe(path)


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Adds ids (array of int) to every row."""
    kept = [c for c in docs.columns if c != "ids"]
    docs = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", ids array<int>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in pieces(batches):
            ids = pa.array([bpe.encode(t.as_py()) for t in batch.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*kept, "ids"])

    return docs.mapInArrow(add, schema)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds decoded (string) from ids to every row."""
    kept = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded string"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in pieces(batches):
            texts = pa.array([bpe.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*kept, "decoded"])

    return encoded.mapInArrow(add, schema)


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ids and decoded to every row, in one pass by one worker."""
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    docs = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", ids array<int>, decoded string"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in pieces(batches):
            ids = [bpe.encode(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=[*kept, "ids", "decoded"])

    return docs.mapInArrow(add, schema)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in pieces(batches):
            rows = []
            for value in batch.column("text"):
                ids = bpe.encode(value.as_py())
                rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(add, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), default_path())
