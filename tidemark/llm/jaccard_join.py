"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the distinct word shingles of its whole text. Two documents link when
100 * |A & B| >= percent * |A | B|.

Signatures. Sizes fall into bands such that linked sets lie in one band or in two neighbours; a
set takes part in the instance of its own band and in that of the next. In an instance with
largest size r, linked sets differ in at most k = floor(2 r (100 - percent) / (100 + percent))
shingles. The shingle domain is hashed into n1 >= ceil((k + 1) / 2) partitions, so in one of them
linked sets differ in at most one shingle; each partition has three cells, and for each of the
three subsets of two cells the shingles in it give one signature: linked sets share one. A
subset without shingles says nothing and would gather unrelated documents, so it is replaced by
the signatures of the partition's shingles, whole and with each one left out, which linked sets
that differ in the third cell alone share as well. For k = 0 the set is the signature.

Partitions with one shingle or none would still gather unrelated sets. n1 is therefore larger by
SPARE: then linked sets agree up to one shingle in m = n1 - floor(k / 2) partitions or more. A set
that has fewer than m partitions of two shingles or less drops those of one or none: of the m, the
two sets drop together fewer than m, as a partition that one of them drops holds two shingles or
less in the other.

Joining. Equal sets are one node. In each bucket (documents with one signature) all nodes meet
its smallest and its largest node only; each node is compared with the first of those it may link
with, and links are joined to components. In buckets that still hold several components, nodes
meet two further nodes, drawn by hash, in each of TURNS turns. Pairs of one bucket whose ends are
then still in different components, and only those, are compared too.
So no link between components is lost, and groups of near copies cost their size, not its
square. A pair counts in the instance of its larger set only.

Sketches. Each node has the parities of its shingles in SKETCH cells. Two sketches differ in no
more bits than their sets differ in shingles, so pairs that differ in more bits than linked sets
may are left out as the buckets are joined. What is left is compared exactly, on whole sets,
which are made again from the packed words of the texts: those take a fraction of the sets' bytes.

Skew. A node is sent once by a task, however many copies of it the task reads. Buckets that still
hold several components are joined in blocks of BLOCK rows. Joins against one row a key (a much
copied node, the root of a large component) are split by Spark's adaptive execution.

Edge cases: null, empty and blank texts have an empty set and link with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; rows with a null doc_id link with
nothing and have a null component; repeated rows are one node; other columns are ignored.
Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable, fresh, lower_words, pieces, read
from tidemark.llm.components import connected_components

SHINGLE = 5
PERCENT = 80
#: Bits of a sketch, 64 in a column; the last bits of a signature name its instance.
SKETCH = 1024
#: Parts in which candidate pairs are sifted.
SLICES = 4
INSTANCE_BITS = 12
#: Share of partitions beyond those that are needed for one agreement.
SPARE = 0.15
#: How often nodes of buckets that hold several components meet further nodes, before all that are left meet.
TURNS = 2
#: Rows of a bucket that one task compares with all of the bucket.
BLOCK = 2000
#: Nodes that a task remembers as sent.
REMEMBERED = 500_000

_U = np.uint64
PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x.astype(_U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    return x ^ (x >> _U(31))


class Hasher:
    """64-bit hashes of words, remembered for a batch."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > 100_000:
            known.clear()
        out = [known.get(w) for w in words]
        for i, h in enumerate(out):
            if h is None:
                out[i] = known[words[i]] = digest(words[i])
        return np.array(out, _U)


def shingles(words: list[bytes], size: int, hasher: Hasher) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.empty(0, _U)
    h = hasher(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), _U)
    for j in range(min(size, len(h))):
        out = (out + h[j : j + n]) * PRIMES[j % 5] ^ (out >> _U(29))
    return np.unique(mix(out))


def node_of(features: np.ndarray) -> int:
    """Identity of a set, as a signed 64-bit number."""
    return int(mix(np.array([mix(features + PRIMES[0]).sum(dtype=_U) + _U(len(features))], _U)).view(np.int64)[0])


@lru_cache(maxsize=8)
def bands(percent: int, upto: int) -> np.ndarray:
    """Largest size of each band, in order, until upto is covered by the last but one."""
    out, low = [], 1
    while len(out) < 2 or out[-2] < upto:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.array(out, np.int64)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of all signatures of non-empty sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tops = bands(percent, 1 << int(sizes.max()).bit_length())
    own = np.searchsorted(tops, sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    done: list[tuple[np.ndarray, np.ndarray]] = []
    every = np.concatenate(sets)
    for band in (own, own + 1):
        salt = mix(band.astype(_U) * PRIMES[1] + _U(percent))
        k = 2 * tops[band] * (100 - percent) // (100 + percent)
        n1 = np.where(k > 0, (k + 2) // 2 + np.ceil(SPARE * (k + 2) / 2).astype(np.int64), 1)
        first = np.concatenate([[0], np.cumsum(n1)])
        owner = np.repeat(np.arange(len(sets)), sizes)
        spread = mix(every ^ salt[owner])
        cell = 3 * first[owner] + (((spread >> _U(32)) * (3 * n1[owner]).astype(_U)) >> _U(32)).astype(np.int64)
        value = mix(spread + PRIMES[2])
        n_cells = 3 * int(first[-1])
        low = np.bincount(cell, weights=(value & _U(0xFFFFFFFF)).astype(float), minlength=n_cells).astype(_U)
        high = np.bincount(cell, weights=(value >> _U(32)).astype(float), minlength=n_cells).astype(_U)
        filled = np.bincount(cell, minlength=n_cells).reshape(-1, 3)
        total = (low + (high << _U(32))).reshape(-1, 3)
        part_owner = np.repeat(np.arange(len(sets)), n1)
        part = np.arange(len(part_owner)) - first[part_owner]
        name = mix(salt[part_owner] + part.astype(_U) * PRIMES[3])
        held = filled.sum(1)
        may_drop = np.bincount(part_owner[held <= 2], minlength=len(sets)) < n1 - k // 2
        dropped = (held <= 1) & may_drop[part_owner] & (k[part_owner] > 0)
        for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            use = (filled[:, i] + filled[:, j] > 0) & (k[part_owner] > 0) & ~dropped
            found.append((part_owner[use], mix((total[use, i] * PRIMES[0] ^ mix(total[use, j])) + name[use] + _U(kind))))
        alone = k[part_owner] == 0
        found.append((part_owner[alone], mix(total[alone].sum(1, dtype=_U) + name[alone] + _U(7))))
        weak = np.flatnonzero(((filled == 0).sum(1) >= 2) & ~alone & ~dropped)
        if len(weak):
            at = np.full(len(part_owner), -1)
            at[weak] = np.arange(len(weak))
            inside = np.flatnonzero(at[cell // 3] >= 0)
            p = cell[inside] // 3
            less = total[p].sum(1, dtype=_U) - value[inside]
            found.append((part_owner[weak], mix(total[weak].sum(1, dtype=_U) + name[weak] + _U(9))))
            found.append((part_owner[p], mix(less + name[p] + _U(9))))
        instance = band.astype(_U)
        found = [*done, *((a, (b >> _U(INSTANCE_BITS) << _U(INSTANCE_BITS)) | instance[a]) for a, b in found)]
        done, found = found, []
    return np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])


SKETCH_COLUMNS = [f"s{j}" for j in range(SKETCH // 64)]


def sketch(features: np.ndarray) -> np.ndarray:
    """Parities of the shingles in SKETCH cells, as signed 64-bit numbers."""
    cells = (mix(features + PRIMES[4]) >> _U(32)) * _U(SKETCH) >> _U(32)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)


def set_table(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (null for empty sets), band and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in pieces(batches):
            n, node, prints = [], [], np.zeros((batch.num_rows, len(SKETCH_COLUMNS)), np.int64)
            for i, text in enumerate(batch.column("text")):
                features = shingles(lower_words(text.as_py()), shingle, hasher)
                n.append(len(features))
                node.append(node_of(features) if len(features) else None)
                prints[i] = sketch(features)
            band = np.searchsorted(bands(percent, 1 << max(n, default=1).bit_length()), np.array(n, np.int64))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(band, pa.int64()), *(pa.array(x) for x in prints.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "node", "band", *SKETCH_COLUMNS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, band long, " + ", ".join(f"{c} long" for c in SKETCH_COLUMNS))


def signature_table(docs: DataFrame, shingle: int, percent: int, words_at_once: int = 200_000) -> DataFrame:
    """sig, node: all signatures; a task gives a node once, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        sent: set[int] = set()

        def piece(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
            nodes = np.array(list(sets), np.int64)
            owner, sig = signatures(list(sets.values()), percent)
            return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(nodes[owner])], names=["sig", "node"])

        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            held = 0
            for text in batch.column("text"):
                features = shingles(lower_words(text.as_py()), shingle, hasher)
                node = node_of(features) if len(features) else None
                if node is not None and node not in sent:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(node)
                    sets[node] = features
                    held += len(features)
                if held > words_at_once:
                    yield piece(sets)
                    sets, held = {}, 0
            if sets:
                yield piece(sets)

    return docs.filter("doc_id is not null").select("text").mapInArrow(run, "sig long, node long")


def packed_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, words (lower-cased, compressed) of the wanted (doc_id, text_key, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches):
            words = [pack(b" ".join(lower_words(text.as_py()))) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(words, pa.binary())], names=["node", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.join(wanted, ["doc_id", "text_key"]).select("node", "text").mapInArrow(run, "node long, words binary")


def sketches(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(prefix + c) for c in ("node", "size", "band", *SKETCH_COLUMNS)))


def may_link(a: str, b: str, percent: int) -> Column:
    """False for pairs whose sketches show that they don't link."""
    bits = sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in SKETCH_COLUMNS), F.lit(0))
    return (100 + percent) * bits <= (100 - percent) * (F.col(a + "size") + F.col(b + "size"))


def instance_of(a: str, b: str) -> Column:
    return F.greatest(a + "band", b + "band")


def in_instance(sig: str) -> Column:
    return F.col(sig).bitwiseAND(F.lit((1 << INSTANCE_BITS) - 1))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets, which are made for these nodes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, unpack = Hasher(), zstandard.ZstdDecompressor().decompress
        features_of = lambda packed: shingles(unpack(packed.as_py()).split(), shingle, hasher)
        last, a = None, None
        for batch in pieces(batches):
            keep = []
            for x, xs, ys in zip(batch.column("a"), batch.column("wa"), batch.column("wb"), strict=True):
                if x.as_py() != last:  # rows come in the order of a
                    last, a = x.as_py(), features_of(xs)
                b = features_of(ys)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # several rows of one node may hold the same doc_id and text
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    words = durable(packed_words(docs, nodes.select("doc_id", "text_key", "node").join(used, "node")).dropDuplicates(["node"]))
    a = words.select(F.col("node").alias("na"), F.col("words").alias("wa"))
    b = words.select(F.col("node").alias("nb"), F.col("words").alias("wb"))
    joined = pairs.join(b, F.col("b") == F.col("nb")).join(a, F.col("a") == F.col("na")).select("a", "b", "wa", "wb")
    out = durable(joined.mapInArrow(run, "a long, b long"), arrow_rows=500)
    discard(words)
    return out


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _sifted(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of (sig, a, b) that lie in the instance of their larger set and may link."""
    pairs = pairs.select(in_instance("sig").alias("instance"), "a", "b").distinct()
    near = pairs.join(sketches(nodes, "x_"), F.col("a") == F.col("x_node")).join(sketches(nodes, "y_"), (F.col("b") == F.col("y_node")) & (F.col("instance") == instance_of("x_", "y_")) & may_link("x_", "y_", percent))
    return near.select("a", "b")


def in_slices(rows: DataFrame, sift: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The distinct results of sift over SLICES parts of the signatures, one after another: that much less disk at a time."""
    found = [durable(sift(rows.filter(F.pmod(F.shiftright("sig", INSTANCE_BITS), F.lit(SLICES)) == i))) for i in range(SLICES)]
    out = durable(reduce(DataFrame.unionByName, found).distinct())
    discard(*found)
    return out


def _still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """sig, node, root and blocks of the buckets whose nodes lie in several components."""
    placed = rows.select("sig", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("low <> high").select("sig", "blocks")
    return durable(placed.join(several, "sig"))


def _turn(turn: int, open_rows: DataFrame, tested: DataFrame, links: DataFrame, roots: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, ...]:
    """Nodes of open buckets meet two further nodes of each, drawn by hash; what they link with is joined."""

    def stars(part: DataFrame) -> DataFrame:
        drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("centre"), F.col("root").alias("centre_root"))
        centres = part.groupBy("sig").agg(F.array(F.min(drawn), F.max(drawn)).alias("c")).select(F.col("sig").alias("sig2"), F.inline("c"))
        met = part.join(centres, (F.col("sig") == F.col("sig2")) & (F.col("root") != F.col("centre_root")))
        return _sifted(met.select("sig", *_pair("node", "centre")), sets, percent)

    found = in_slices(open_rows, stars)
    new = durable(found.join(tested, ["a", "b"], "left_anti"))
    more = verified(new, docs, sets, shingle, percent)
    all_tested, all_links = durable(tested.unionByName(new)), durable(links.unionByName(more))
    now = durable(connected_components(all_links))
    left = _still_open(open_rows, now)
    discard(found, new, more, tested, links, roots, open_rows)
    return left, all_tested, all_links, now


def clusters(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The durable tables (doc_id, text_key, n_shingles, node) of all rows, node null where nothing
    links, and (node, doc_id, root) of all nodes: smallest doc_id and component."""
    table = durable(set_table(docs, shingle, percent).withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))))
    first = F.min(F.struct("doc_id", "text_key", F.col("n_shingles").alias("size"), "band", *SKETCH_COLUMNS)).alias("x")
    sets = durable(table.filter("node is not null").groupBy("node").agg(first).select("node", "x.*"))
    by_sig = Window.partitionBy("sig")
    buckets = signature_table(docs, shingle, percent).withColumns({"first": F.min("node").over(by_sig), "last": F.max("node").over(by_sig)})
    # repeated (sig, node) rows of copies go here, where rows are few
    buckets = durable(buckets.filter("first <> last").distinct())
    centres = F.explode(F.array("first", "last")).alias("centre")
    stars = in_slices(buckets, lambda part: _sifted(part.select("sig", "node", centres).filter("node <> centre").select("sig", *_pair("centre", "node")), sets, percent))
    # one pair of each node first: most other pairs then lie inside a component
    tested = durable(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    discard(stars)
    links = verified(tested, docs, sets, shingle, percent)
    roots = durable(connected_components(links))
    open_rows = _still_open(buckets, roots)
    discard(buckets)
    for turn in range(TURNS):
        open_rows, tested, links, roots = _turn(turn, open_rows, tested, links, roots, docs, sets, shingle, percent)

    def across(part: DataFrame) -> DataFrame:
        left = part.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).join(sketches(sets, "x_"), F.col("node") == F.col("x_node"))
        right = part.select(F.col("sig").alias("sig2"), F.col("node").alias("node2"), F.col("root").alias("root2"), "blocks").join(sketches(sets, "y_"), F.col("node2") == F.col("y_node"))
        right = right.withColumn("block2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        near = (F.col("sig") == F.col("sig2")) & (F.col("block") == F.col("block2")) & (F.col("root") < F.col("root2")) & (in_instance("sig") == instance_of("x_", "y_")) & may_link("x_", "y_", percent)
        return left.join(right, near).select(*_pair("node", "node2")).distinct()

    fresh_pairs = in_slices(open_rows, across)
    more = verified(fresh_pairs.join(tested, ["a", "b"], "left_anti"), docs, sets, shingle, percent)
    old, roots = roots, durable(connected_components(links.unionByName(more)))
    nodes = durable(sets.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(old, roots, sets, tested, links, open_rows, fresh_pairs, more)
    return table.select("doc_id", "text_key", "n_shingles", "node"), nodes


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    table, nodes = clusters(docs, shingle, percent)
    ids = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = nodes.select("node", "root").join(ids, "root").select("node", "component_id")
    linked = table.filter("node is not null").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(table.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with its columns.

    Rows are decided by doc_id and text, so different texts under one doc_id go or stay on their
    own; of rows that repeat both, one stays. Blank texts and rows with a null doc_id all stay,
    but for blank rows that repeat both.
    """
    key, nth = fresh(docs.columns, "text_key", "nth")
    table, nodes = clusters(docs, shingle, percent)
    rooted = table.filter("node is not null").join(nodes.select("node", "root"), "node")
    stay = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.*")
    stay = stay.unionByName(table.filter("node is null and doc_id is not null").select("doc_id", "text_key").distinct()).select(F.col("doc_id").alias("stay_id"), F.col("text_key").alias("stay_key"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    own = keyed.filter(F.col("doc_id").isNotNull()).alias("d")
    kept = own.join(stay.alias("s"), (F.col("d.doc_id").cast("long") == F.col("s.stay_id")) & (F.col(f"d.`{key}`") == F.col("s.stay_key")), "left_semi")
    again = Window.partitionBy(F.col("doc_id").cast("long"), key).orderBy("doc_id")
    kept = kept.withColumn(nth, F.row_number().over(again)).filter(F.col(nth) == 1)
    return kept.select(*_named(docs)).unionByName(docs.filter(F.col("doc_id").isNull()))


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), shingle=3, percent=90)
