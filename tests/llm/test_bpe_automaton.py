import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe_automaton as bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(3)
    words = ["the", "Hello", "it's", "İstanbul", "naïve", "ﬁne", "日本語", "🙂👍", "don't!!", "x" * 300, "1234567", "<|endoftext|>", "<|startoftext|>a", "á", "ǅ", "​", "﻿", "Straße", "ΑΣ", "\x00", "a b", " ", "foo_bar", "()[]{}", "...", "ẹ̈", "𝔘𝔫𝔦", "''s", "ll'll"]
    out = ["", " ", "\n\t ", "word", *words]
    for _ in range(300):
        out.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "", "\t"]) for _ in range(rng.randrange(1, 12))))
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x370, 0x500)])) for _ in range(rng.randrange(40))))
    return out


def test_equals_library(library):
    own = bpe.load(PATH)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    own = bpe.WordBpe(PATH)
    for text in texts()[:120]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_queries_and_edges(spark, library):
    rows = [(1, "Hello the WORLD"), (1, "Hello the WORLD"), (2, None), (3, ""), (None, "a b"), (5, "long " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    both = bpe.encode_and_decode(docs, PATH).collect()
    apart = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(map(str, (r.asDict() for r in both))) == sorted(map(str, (r.asDict() for r in apart)))
    assert bpe.digests(docs.filter("false"), PATH).count() == 0
