"""URL filter, quality rules, mixing, line dedup and the pipeline on small fixtures."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe_automaton, line_dedup, mixing, quality_rules, url_filter
from tidemark.llm.common import WORD, durable, words

BLOCK, ALLOW = ["net/", "example.com/de/", "a.b.org/x"], ["example.net/en/", "org/fr/", "b.org/"]
URLS = [None, "", "no scheme", "http://example.net/en/a?b#c", "https://X.Example.NET/", "ftp://net", "http://net/", "http://www.example.com/de/x", "http://example.com/dex", "http://a.b.org/xyz", "http://a.b.org/", "http://c.org/fr/", "http://c.org/fr", "http://c.org/FR/", "x://://org/fr/", "http://example.com.net/?u", "http://.net/", "http://net./", "http://ÉX.net/\nq"]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for rule, verdict in [(r, "block") for r in BLOCK] + [(r, "allow") for r in ALLOW]:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(h), len(p), rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("limit", [10**8, 0])
def test_url_rules(spark, limit):
    df = spark.createDataFrame([(i, u, "clash", "x", f"h{i}") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, verdict string, hit_ string")
    assert [r.hit_ for r in url_filter.judge(df, BLOCK, ALLOW, max_trie_bytes=limit).orderBy("page_id").collect()] == [f"h{i}" for i in range(2 * len(URLS))]
    got = url_filter.judge(df, BLOCK, ALLOW, max_trie_bytes=limit).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judged(u) for u in URLS + URLS]
    assert url_filter.judge(df.filter("false"), BLOCK, ALLOW).count() == 0


@pytest.mark.parametrize("limit", [10**8, 0])
def test_url_ties_and_long_urls(spark, limit):
    deep = "http://" + "sub." * 5000 + "tie.org/" + "a/" * 20_000
    df = spark.createDataFrame([(0, "http://tie.org/x"), (1, deep), (2, deep + "z"), (3, "http://tie.org/")], "page_id long, url string")
    got = url_filter.judge(df, ["tie.org/", "tie.org/x"], ["tie.org/", "tie.org/" + "a/" * 20_000], max_trie_bytes=limit).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "allow", "allow", "block"] and got[0].rule == "tie.org/x"


def test_trie_counts_its_bytes():
    trie = url_filter.UrlTrie()
    for i in range(2000):
        trie.add(f"host{i}.example{i % 50}.com/p{i}/", "block")
    tracemalloc.start()
    again = url_filter.UrlTrie()
    for i in range(2000):
        again.add(f"host{i}.example{i % 50}.com/p{i}/", "block")
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0.7 * held < trie.bytes < 1.6 * held


def test_binomial_tail():
    for k, n in ((0, 10), (2, 400), (3, 400), (9, 1000)):
        exact = sum(math.comb(n, i) * Fraction(1, 100) ** i * Fraction(99, 100) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, 0.01) == pytest.approx(float(exact), rel=1e-9)
    assert quality_rules.binomial_tail(9_000_000, 1_000_000_000, 0.01) < 1e-9
    assert quality_rules.certified([0, 0, 3, 0, 0, 0], 700, 0.01, 0.01) == 0.75
    assert quality_rules.certified([8, 0, 0, 0, 0, 0], 700, 0.01, 0.01) is None


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean and symbol-laden texts in three languages with a certified cutoff, and one with too few labels."""
    rng = random.Random(1)
    text = lambda bad: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10_000)) + ("###" if bad else "") for _ in range(80))
    rows = [(i, text(i % 9 == 0), ("en", "de", None)[i % 3] if i < 2400 else "fr", "s") for i in range(2700)]
    rows += [(2700 + i, rows[2401][1], "fr", "s") for i in range(900)] + [(5000, None, None, "s"), (5001, "", "en", "s"), (5001, "", "en", "s"), (5002, "a b " * 60_000, "zz", "s")]
    docs = spark.createDataFrame([(*r, 7, f"x{r[0]}", "y", "z") for r in rows], "doc_id long, text string, lang string, source string, n_words int, cutoff string, `a.b` string, kept string")
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(2700)] + [(2700 + i, 1) for i in range(900)] + [(3, None), (None, 1)], "doc_id long, quality int")
    return docs, labels


def test_cutoffs(spark, labelled):
    docs, labels = labelled
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all((r.n_words, r.cutoff, r.kept) == (7, f"x{r.doc_id}", "z") for r in got)
    # copies count once, so French has 268 clean texts, too few
    assert {r.doc_id for r in got} == {i for i in range(2400) if i % 9} | set(range(2400, 3600))
    _, cutoffs = quality_rules.fit(docs, labels)
    assert {r.stratum for r in cutoffs.collect()} == {"en", "de", ""}
    none = quality_rules.keep_good(docs, labels.filter("false"))
    assert {r.doc_id for r in none.collect()} == set(range(3600))
    assert quality_rules.keep_good(docs.filter("false"), labels).count() == 0


def test_cutoffs_equal_sql(spark, labelled, tmp_path):
    docs, labels = labelled
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(score, 9), kept"
    want = con.execute(f"SELECT {columns} FROM ({quality_rules.OP3_SQL})").fetchall()
    got = quality_rules.op3_quality_rules(spark, str(tmp_path)).selectExpr(*columns.split(", ")[:7], "round(score, 9)", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r[-1] for r in want if not r[6]}) == 2


def test_counts():
    assert quality_rules.counts_of("a b c a b c\n\n x \nx\nx")[:5] == (9, 9, 0, 1, 6)
    assert quality_rules.repeated_words(b"a a a a".split()) == 4
    assert quality_rules.repeated_words(b"a b c".split()) == 0


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        source = rng.choice(["big"] * 6 + ["mid"] * 2 + ["small", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), source, "clash"))
    rows += [(7, "a b c", "big", "x")] * 3 + [(None, None, "mid", "x"), (9000, "z " * 20_000, "mid", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken string"), rows


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        free -= over
        if not free:
            return out


def test_mixing(spark, sources):
    docs, rows = sources
    got = mixing.mix(mixing.with_sizes(docs), shard_docs=500).collect()
    again = mixing.mix(mixing.with_sizes(docs.repartition(7)), shard_docs=500).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(words(t))
    want = targets_by_hand(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.01 * want[s] + 16
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    mixed = out.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(WORD)))).collect()
    whole = defaultdict(int)
    for r in mixing.mix(mixing.with_sizes(docs)).collect():
        whole[r.source] += r.taken
    assert {r[0]: r[1] for r in mixed} == dict(whole)
    assert mixing.mix(mixing.with_sizes(docs.filter("false"))).count() == 0
    assert mixing.mixed_documents(docs.filter("false")).count() == 0


def test_mixing_passes_clashing_columns_and_takes_what_mix_says(spark):
    names = ["a", "b", "c", "d", "s", "h", "rounds", "id_", "size", "size_", "order_key", "how", "whole", "target", "low", "a.b"]
    rows = [(i % 40 if i else None, " ".join(f"{i}-{j}" for j in range(i % 23)), f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(120)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.mixed_documents(df, shard_docs=9)
    assert out.columns == df.columns
    taken = mixing.mix(mixing.with_sizes(df), shard_docs=9).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect()
    got = Counter()
    for r in out.collect():
        i = int(r.id_[3:])
        assert tuple(r)[3:] == rows[i][3:] and set(r.text.split()) <= set(rows[i][1].split()) and r.text
        got[r.doc_id, r.source] += len(r.text.split())
    assert got == Counter({(r.doc_id, r.source): r.n for r in taken if r.n})


def test_apportion_with_hundreds_of_small_shares(spark):
    rows = [(0, k, 3.0 if k == 0 else 0.01, 9) for k in range(601)] + [(1, k, 1.0, 7) for k in range(300)] + [(2, k, float(k % 5), 1000) for k in range(400)] + [(3, k, 0.5 + k, 40) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, w double, h long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, F.col("w"), F.col("h"), ["g"], [F.col("k")]).collect()}
    for g in range(4):
        w, n = {k: x for gg, k, x, _ in rows if gg == g}, next(h for gg, _, _, h in rows if gg == g)
        best = sorted(((-w[k] / (2 * j + 1), k) for k in w if w[k] for j in range(n)))[:n]
        seats = Counter(k for _, k in best)
        assert {k: got[g, k] for k in w} == {k: seats[k] for k in w}
    assert got[0, 0] == 9


def test_apportion_equals_highest_quotients(spark):
    rng = random.Random(5)
    rows = [(g, k, float(rng.choice([0, 1, 3, 50, 977]))) for g in range(4) for k in range(7)]
    house = {0: 0, 1: 5, 2: 100, 3: 1003}
    df = spark.createDataFrame([(*r, house[r[0]]) for r in rows], "g int, k int, w double, h long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, F.col("w"), F.col("h"), ["g"], [F.col("k")]).collect()}
    for g, n in house.items():
        w = {k: x for gg, k, x in rows if gg == g}
        seats = Counter()
        for _ in range(n if any(w.values()) else 0):
            seats[max((k for k in w if w[k]), key=lambda k: (w[k] / (2 * seats[k] + 1), -k))] += 1
        assert {k: got[g, k] for k in w} == {k: seats[k] for k in w}


def runs_by_hand(rows, n):
    """Deletes every line of any run of n words or more that stands at an earlier place."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = t.split("\n")
        at = [k for k, x in enumerate(raw) if x.split()]
        gone = set()
        for a in range(len(at)):
            held, run = 0, ()
            for b in range(a, len(at)):
                held += len(raw[at[b]].split())
                run += (" ".join(raw[at[b]].split()),)
                if held >= n:
                    if run in seen:
                        gone.update(at[a : b + 1])
                    seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(raw) if k not in gone)
    return out


def test_line_dedup_equals_direct_definition(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 20])))
    passages = [[line() for _ in range(rng.choice([2, 5, 9]))] for _ in range(6)]
    rows = []
    for i in range(150):
        text = [line() for _ in range(rng.randrange(4))]
        if rng.random() < 0.7:
            text += rng.choice(passages)
        rows.append((i, "\n".join([*text, "", line()])))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, runs_ string, text_key string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, 20).collect()}
    assert got == runs_by_hand(rows, 20) and any(got[i] != t for i, t in rows)


def test_line_dedup_deletes_whole_runs(spark):
    rng = random.Random(16)
    line = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    rows = []
    for sizes in ((20, 15, 15, 10), (45, 5, 40), (10, 60, 3), (3, 60, 49)):
        passage = [line(n) for n in sizes]
        rows += [(len(rows) + j, "\n".join([line(7), *passage, line(7)])) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == runs_by_hand(rows, 50)
    assert [len(got[i].split()) for i in (1, 3, 5, 7)] == [14] * 4


def test_line_dedup_equals_runs_by_hand(spark):
    rng = random.Random(26)
    line = lambda: " ".join(f"w{rng.randrange(3)}" for _ in range(rng.choice([1, 2, 3, 8, 20])))
    passages = [[line() for _ in range(rng.choice([2, 5, 9]))] for _ in range(6)]
    rows = []
    for i in range(150):
        text = [line() for _ in range(rng.randrange(4))] + [x for p in rng.sample(passages, 2) for x in p[rng.randrange(3) :]]
        rows.append((i, "\n".join([*text, "", line()])))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert got == runs_by_hand(rows, 20) and any(got[i] != t for i, t in rows)


def test_minima_are_sparse_and_guaranteed():
    rng = random.Random(36)
    line = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(rng.randrange(1, 12)))
    run = [line() for _ in range(40)]
    marks = []
    for _ in range(2):
        lines = line_dedup.word_lines("\n".join([line() for _ in range(9)] + run + [line() for _ in range(9)]))
        found = line_dedup.windows(lines, 50)
        assert len({at for *_, at, _ in found}) < len(lines) / 2
        marks.append({lines[at][2] for first, last, at, _ in found if first >= 9 and last < 49})
    assert marks[0] == marks[1]


def test_line_dedup_passes_clashing_columns(spark):
    text = "\n".join("a b c d e f g h i %d" % i for i in range(9))
    names = ["id_", "text_key_", "runs_", "text_key", "runs", "n_deleted", "deleted_words", "d", "r", "a.b"]
    rows = [(i, text, *(f"{n}{i}" for n in names)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = line_dedup.cleaned_documents(df)
    assert out.columns == df.columns and out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert {tuple(r)[2:] for r in out.collect()} == {r[2:] for r in rows}
    assert sorted(r.text for r in out.collect()) == ["", "", text]


def test_line_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    long = "\n".join(f"line {i} of a very long text" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, long), (4, long), (3, long), (None, long)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()
    found = sorted((str(r.doc_id), r.n_deleted, r.text or "") for r in got)
    assert [(a, b) for a, b, _ in found] == [("1", 0), ("2", 0), ("3", 0), ("3", 0), ("4", 20_000), ("None", 20_000)]


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows, clashing columns, a very long text; then an empty table."""
    rng = random.Random(19)
    lines = lambda n: "\n".join(" ".join(str(rng.randrange(10**6)) for _ in range(12)) for _ in range(n))
    long, common = lines(4000), lines(8)
    names = ["id_", "text_key", "node", "n_words", "size", "order_key", "nth", "n_deleted", "kept", "a.b"]
    texts = [(1, long), (2, long), (3, common), (3, common), (None, common), (None, lines(8)), (4, None), (5, ""), (6, "short"), (7, lines(9)), (7, lines(9))]
    rows = [(i, t, None if j % 2 else "en", f"s{j % 2}", None, *(f"{n}{j}" for n in names)) for j, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, table in (("full", docs), ("empty", docs.filter("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        step = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        left = []
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            step = durable(stage(spark, step, f"{tmp_path}/{name}"))
            assert step.columns == docs.columns, stage_name
            assert {tuple(r)[5:] for r in step.collect()} <= {r[5:] for r in rows}
            left.append(Counter(r.doc_id for r in step.collect()))
        if name == "empty":
            assert not any(left)
        else:
            assert left[0] == left[1] == Counter({1: 1, 2: 1, 3: 2, None: 2, 7: 2})
            # the copies' lines are gone, so 2 and one null row are blank and stay
            assert left[2] == Counter({1: 1, 2: 1, 3: 1, None: 2, 7: 2})
            assert set(left[3]) <= {1, 3, None, 7} and 1 in left[3]
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
        assert {r.doc_id for r in out.collect()} == set(left[3])


def test_pipeline_equals_stages_by_hand(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))
    rows = []
    for i in range(120):
        text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(rng.randrange(6, 20)))
        if i % 10 == 3:
            text += "\n" + passage
        if i % 10 == 4:
            text = rows[-4][1] if len(rows) > 4 else text
        if i % 10 == 5:
            text = "too short"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows.append((500, None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    good = {i: t for i, t, *_ in rows if t and len(t.split()) >= 50}
    lines = runs_by_hand(list(good.items()), 50)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in lines.items()}
    first = {}
    for i in sorted(sets):
        hits = [first[j] for j in first if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        first[i] = min(hits, default=i)
    alone = {i for i in first if first[i] == i}
    mixed = {r.doc_id: r.taken for r in mixing.mix(mixing.with_sizes(spark.createDataFrame([(i, lines[i], rows[i][3]) for i in alone], "doc_id long, text string, source string"))).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i, n in mixed.items() if n}
    got = Counter()
    own = bpe_automaton.load(bpe_automaton.default_path())
    for r in out:
        assert r.n_tokens == len(r.ids) and r.decoded == own.decode(r.ids)
        got[r.doc_id] += r.n_tokens
    for r in out:
        if mixed[r.doc_id] % len(lines[r.doc_id].split()) == 0:
            assert got[r.doc_id] == mixed[r.doc_id] // len(lines[r.doc_id].split()) * len(own.encode(lines[r.doc_id]))
