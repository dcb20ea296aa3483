"""Phrase collocation mining: generalised suffix automata per shard, counts reduced globally.

Texts are cut into pieces at punctuation, pieces into words; a phrase is a run of words inside a
piece. A phrase found `least` times needs words and pairs of words found as often, so Spark first
counts words exactly, then sieves:

1. Words: tasks add up their own texts, Spark sums by (lang, word).
2. Pairs: of words that the first sieve lets through, by 64-bit hashes of language and words.
3. Phrases: runs in which every pair comes through the second sieve go into a generalised suffix
   automaton for each shard of SHARD_WORDS words. Each state has the number of its end positions; a
   state stands for all phrases longer than its suffix link's and up to its own length. A task sends
   windows only: the last `most_words` words up to each position, fewer at the start of a run. Spark
   deals them by their ends and sums each phrase over the windows that end with it, so a word sends
   one row at most, where it stands in up to `most_words` - 1 phrases that end there.

A sieve is a bitmap of the hashes that are frequent, of at most MOST_BITS bits. Sums by hash are
never too small, so a sieve loses nothing, however full it is; it only spares shuffles, and all counts
that are used are of words themselves. Tasks add up before they send, so the most common phrase
arrives once from each task.

Subsumption. A phrase found as often as one that holds it has the same end positions in the
automaton of the whole corpus; then one of the phrases with one word more has that count as well
(the one between them). So a candidate is held against its extensions only: each one sends its count
along its suffix link (without the first word) and to its prefix (without the last).

Edge cases: null texts have no words; null languages are `und`; words are never cut, whatever their
length; runs longer than a shard are cut with an overlap that is counted once; repeated rows count as
often as they stand there; ties in score and count are ordered by the phrase's bytes; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_TABLE, durable, pieces, read

DELIMITERS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z and makes one mark of all that ends a piece.
TABLE = bytes(ord(".") if b in DELIMITERS else LOWER_TABLE[b] for b in range(256))
BREAK = 0
WORDS_AT_ONCE = 2_000_000
SHARD_WORDS = 150_000
#: Different phrases whose counts a task holds before it sends those of the language at hand.
PHRASES_AT_ONCE = 400_000
MOST_BITS = 1 << 29
BITS_EACH = 32
SALTS = 16


class Words(dict):
    """Numbers of words from 1, BREAK for the end of a piece, and their hashes with the language."""

    def __init__(self, lang: str) -> None:
        super().__init__({b".": BREAK})
        self.names, self.hashes = [b"."], [0]
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return number


def numbered(text: str | None, words: Words) -> np.ndarray:
    """Word numbers of a text in order, with BREAK around each piece."""
    parts = (text or "").encode().translate(TABLE).replace(b".", b" . ").split()
    return np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))


def by_shards(docs: DataFrame, task: Callable[[], Callable[[str, Words | None, np.ndarray | None], pa.RecordBatch | None]], schema: str, at_once: int) -> DataFrame:
    """task() makes a task's function of (lang, words, numbers), called for about at_once words of one language at a time.

    BREAK parts the texts. At the end it is called once more for each language, with words and numbers null, for what it has kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Words, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        work, langs = task(), set()

        def out(lang: str, words: Words | None, numbers: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            found = work(lang, words, numbers)
            if found is not None:
                yield found.append_column("lang", pa.array([lang] * found.num_rows, pa.string()))

        def finished(lang: str) -> Iterator[pa.RecordBatch]:
            words, parts = held.pop(lang)
            del sizes[lang]
            langs.add(lang)
            yield from out(lang, words, np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int64))]))

        for batch in pieces(batches):
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                lang = lang.as_py()
                words, parts = held.setdefault(lang, (Words(lang), []))
                parts.append(numbered(text.as_py(), words))
                sizes[lang] = sizes.get(lang, 0) + len(parts[-1])
                if sizes[lang] > at_once or sum(sizes.values()) > 2 * at_once:
                    yield from finished(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from finished(lang)
        for lang in langs:
            yield from out(lang, None, None)

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, schema + ", lang string")


def each(work: Callable[[Words, np.ndarray], pa.RecordBatch]) -> Callable:
    """A task that keeps nothing."""
    return lambda: lambda lang, words, numbers: None if words is None else work(words, numbers)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of every word."""

    def count(words: Words, numbers: np.ndarray) -> pa.RecordBatch:
        n = np.bincount(numbers, minlength=len(words.names))[1:]
        return pa.RecordBatch.from_arrays([pa.array(words.names[1:], pa.binary()).cast(pa.string()), pa.array(n), pa.array(np.array(words.hashes[1:], np.uint64).view(np.int64))], names=["word", "n", "hash"])

    return by_shards(docs, each(count), "word string, n long, hash long", WORDS_AT_ONCE).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("hash").alias("hash"))


class Sieve:
    """Which hashes may be frequent; a bit for each residue."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sieve_of(frequent: DataFrame) -> Sieve:
    """The sieve of the hashes in a table; at most MOST_BITS / 8 bytes come to the driver."""
    n = frequent.count()
    size = 1 << 15
    while size < min(MOST_BITS, BITS_EACH * n):
        size *= 2
    at = F.col("hash").bitwiseAND(F.lit(size - 1))
    parts = frequent.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("place")).groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return Sieve(out)


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its start and of its last word."""
    with np.errstate(over="ignore"):
        x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ word
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def summed(hashes: np.ndarray) -> pa.RecordBatch:
    hashes, n = np.unique(hashes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])


def frequent_hashes(counted: DataFrame, least: int) -> DataFrame:
    """Hashes found often enough. Rows are dealt by hash before they are added up, as each task has added up its own."""
    return counted.repartition("hash").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("hash")


def frequent_pairs(docs: DataFrame, sieve, least: int) -> DataFrame:
    """hash of all pairs of words that may be found `least` times."""

    def count(words: Words, numbers: np.ndarray) -> pa.RecordBatch:
        hashes = np.array(words.hashes, np.uint64)
        through = sieve.value(hashes)
        through[BREAK] = False
        both = through[numbers[:-1]] & through[numbers[1:]]
        own = hashes[numbers]
        return summed(mixed(own[:-1][both], own[1:][both]))

    return frequent_hashes(by_shards(docs, each(count), "hash long, n long", WORDS_AT_ONCE).select("hash", "n"), least)


class Automaton:
    """A generalised suffix automaton over runs of numbers, with the number of end positions of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.times, self.end = [-1], [0], [0], [-1]
        self.heads: dict[int, int] = {}
        self.n = 0

    def _state(self, follow: dict[int, int], link: int, length: int, end: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.times.append(0)
        self.end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state of its own for the phrases of q that are reached from p and its links."""
        nexts, link, length = self.next, self.link, self.length
        apart = self._state(dict(nexts[q]), link[q], length[p] + 1, self.end[q])
        link[q] = apart
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = apart
            p = link[p]
        return apart

    def add(self, run: list[int], uncounted: int = 0, heads: int = 0) -> None:
        """Adds a run; its first `uncounted` positions are known already as the end of the run before.

        Of its first `heads` positions, the whole start of the run up to there is counted in `heads` too.
        """
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for i, word in enumerate(run):
            q = nexts[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
            else:
                new = self._state({}, 0, length[last] + 1, self.n + i)
                p = last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
                last = new
            if i >= uncounted:
                self.times[last] += 1
            if i < heads:
                self.heads[last] = self.heads.get(last, 0) + 1
        self.n += len(run)

    def phrases(self, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, a place where it ends, times) of all phrases of these lengths; places count the words added."""
        length, link, times = np.array(self.length), np.array(self.link), self.times
        for v in np.argsort(-length, kind="stable").tolist():
            if self.link[v] > 0:
                times[self.link[v]] += times[v]
        shorter = np.where(link >= 0, length[link], -1)
        n, end = np.array(times, np.int64), np.array(self.end)
        for words in lengths:
            here = (shorter < words) & (length >= words) & (n > 0)
            yield words, end[here], n[here]

    def windows(self, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As phrases(), of windows: the last `most_words` words up to a position, or two words or more from the start of a run.

        A start is the longest phrase of its state, and stays so when states are split.
        """
        yield from self.phrases(range(most_words, most_words + 1))
        states, n = np.array(list(self.heads), np.int64), np.array(list(self.heads.values()), np.int64)
        length, end = np.array(self.length)[states], np.array(self.end)[states]
        for words in range(2, most_words):
            here = length == words
            yield words, end[here], n[here]


def runs_of(numbers: np.ndarray, hashes: np.ndarray, words_through: np.ndarray, pairs) -> list[tuple[int, int]]:
    """(start, end) of the longest runs of two words or more whose pairs all come through."""
    both = words_through[numbers[:-1]] & words_through[numbers[1:]]
    own = hashes[numbers]
    both[both] = pairs(mixed(own[:-1][both], own[1:][both]))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], both.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True))


def automata(words: Words, numbers: np.ndarray, sieves, most_words: int, shard_words: int) -> Iterator[tuple[Automaton, np.ndarray]]:
    """The automaton of each shard and the word numbers added to it."""
    word_sieve, pair_sieve = sieves
    hashes = np.array(words.hashes, np.uint64)
    through = word_sieve(hashes)
    through[BREAK] = False
    own, held = Automaton(), []
    overlap = most_words - 1
    for start, end in runs_of(numbers, hashes, through, pair_sieve):
        for at in range(start, max(start + 1, end - overlap), shard_words):
            part = numbers[at : min(end, at + shard_words + overlap)]
            own.add(part.tolist(), *((0, overlap) if at == start else (overlap, 0)))
            held.append(part)
            if own.n >= shard_words:
                yield own, np.concatenate(held)
                own, held = Automaton(), []
    if held:
        yield own, np.concatenate(held)


def counted_windows(docs: DataFrame, sieves, most_words: int, shard_words: int) -> DataFrame:
    """lang, phrase, size, n of all windows whose words and pairs come through the sieves; a row for each task that has one, or more."""

    def task() -> Callable:
        totals: dict[str, dict[bytes, int]] = {}

        def sent(lang: str) -> pa.RecordBatch | None:
            total = totals.pop(lang, None)
            if not total:
                return None
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array([p.count(b" ") + 1 for p in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["phrase", "size", "n"])

        def add(lang: str, words: Words | None, numbers: np.ndarray | None) -> pa.RecordBatch | None:
            if words is None:
                return sent(lang)
            total, names = totals.setdefault(lang, {}), words.names
            for own, every in automata(words, numbers, sieves.value, most_words, shard_words):
                for length, ends, n in own.windows(most_words):
                    found = zip(*(every[ends - back].tolist() for back in range(length - 1, -1, -1)), strict=True)
                    for phrase, times in zip(found, n.tolist(), strict=True):
                        name = b" ".join([names[w] for w in phrase])
                        total[name] = total.get(name, 0) + times
            return sent(lang) if sum(map(len, totals.values())) > PHRASES_AT_ONCE else None

        return add

    return by_shards(docs, task, "phrase string, size int, n long", WORDS_AT_ONCE)


def counted_phrases(windows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size, n of all phrases of two words or more found `least` times, from windows that may come in several rows.

    A phrase is found once for each window that ends with it. Windows are dealt by their last three words,
    so all that end with a phrase of three words or more are together, and a task counts it wholly. Pairs are
    summed over the phrases of three words that end with them, as one common pair may end a large share of all windows.
    """
    by = ["lang", "last", "phrase", "size"]
    cut = lambda df: df.withColumn("phrase", F.expr("substring_index(phrase, ' ', -k)")).withColumn("size", F.col("k")).drop("k")
    dealt = windows.withColumn("last", F.substring_index("phrase", " ", -3)).repartition("lang", "last").groupBy(by).agg(F.sum("n").alias("n"))
    ends = cut(dealt.withColumn("k", F.explode(F.sequence(F.least(F.lit(3), "size"), "size"))))
    whole = ends.groupBy(by).agg(F.sum("n").alias("n")).drop("last").withColumn("k", F.explode(F.expr("if(size = 3, array(3, 2), array(size))")))
    parts = cut(whole.filter((F.col("k") == 2) | (F.col("n") >= least)))
    return parts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _words_of(k: Column | int, rest: bool = False) -> Column:
    """The first k words of phrase, or what follows them."""
    words = F.split("phrase", " ", -1)
    return F.array_join(F.slice(words, k + 1, F.col("size") - k) if rest else F.slice(words, 1, k), " ")


def counts(docs: DataFrame, least: int, most_words: int, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of one word or more (lang, phrase, size, n), and lang, n: all words of each language."""
    spark = docs.sparkSession
    words = durable(word_counts(docs))
    shared = lambda *sieves: spark.sparkContext.broadcast(sieves if len(sieves) > 1 else sieves[0])
    common = words.filter(F.col("n") >= least)
    word_sieve = sieve_of(common.select("hash"))
    pair_sieve = sieve_of(durable(frequent_pairs(docs, shared(word_sieve), least)))
    windows = counted_windows(docs, shared(word_sieve, pair_sieve), most_words, shard_words)
    longer = durable(counted_phrases(windows, least))
    single = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    return single.unionByName(longer), words.groupBy("lang").agg(F.sum("n").alias("n"))


def unsubsumed(candidates: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, n) that no longer one is found as often as."""
    above = candidates.filter("size > 2").select("lang", F.explode(F.array(_words_of(F.col("size") - 1), _words_of(1, rest=True))).alias("phrase"), F.col("n").alias("above"))
    most = above.groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    return candidates.join(most, ["lang", "phrase"], "left").filter("above is null or above < n").drop("above")


def _parts(cuts: DataFrame, table: DataFrame, part: str, name: str) -> DataFrame:
    """Adds the count of the phrase in column `part`. Salted, as many phrases start or end with one word."""
    salted = table.select("lang", F.col("phrase").alias(part), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return cuts.withColumn("salt", F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS)).cast("int")).join(salted, ["lang", part, "salt"]).drop("salt")


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, first: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language, by their weakest cut."""
    table, totals = counts(docs, least, most_words, shard_words)
    kept = unsubsumed(table.filter("size > 1")).withColumnRenamed("n", "a")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("*", _words_of(F.col("k")).alias("left_"), _words_of(F.col("k"), rest=True).alias("right_"))
    cuts = _parts(_parts(cuts, table, "left_", "l"), table, "right_", "r").join(totals, "lang")
    exact = {c: f"cast({c} as decimal(17, 0))" for c in "alrn"}
    # the quotient is at most 1000 n / least, as a phrase is no more frequent than its parts
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000 as decimal(4, 0)) * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return weakest.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def _oracle(least: int = 100, most_words: int = 5, first: int = 2000) -> str:
    return f"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as w
  from documents where text is not null),
f as (
  select lang, k as size, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as n
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces cross join range(1, {most_words + 1}) s(k))
  group by all having count(*) >= {least}),
totals as (select lang, sum(len(w)) as n from pieces group by lang),
above as (
  select lang, phrase, max(n) as above from (
    select lang, n, array_to_string(string_split(phrase, ' ')[:size - 1], ' ') as phrase from f where size > 2
    union all select lang, n, array_to_string(string_split(phrase, ' ')[2:], ' ') from f where size > 2)
  group by all),
cuts as (
  select c.lang, c.phrase, c.n as a, unnest(range(1, c.size)) as k, string_split(c.phrase, ' ') as w
  from f c left join above u on u.lang = c.lang and u.phrase = c.phrase
  where c.size > 1 and (u.above is null or u.above < c.n)),
scored as (
  select c.lang, c.phrase, c.k, c.a, l.n as l, r.n as r, t.n as n, ((1000::hugeint * c.a * t.n) // (l.n::hugeint * r.n))::bigint as score
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[:c.k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ') join totals t on t.lang = c.lang),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a, l, r, n::bigint as n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest) where rank <= {first}"""


OP13_SQL = _oracle()
