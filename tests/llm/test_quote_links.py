import random

from pyspark.sql import functions as F

from tidemark.llm import quote_links as ql

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "Shall we meet on Monday morning?\n\nBring the long blue report."),
        (1, 1, "user", "Something else entirely here, please."),
        (1, 2, "bot", "On Tuesday A wrote:\n> Shall we meet on\n> MONDAY  morning?\n\nYes."),
        (1, 3, "user", "Fine.\n> > Shall we meet on Monday morning?\n> Yes.\n\nSo it is."),
        (1, 4, "user", "> never said anywhere at all\nWho said this?"),
        (2, 7, "user", "> Shall we meet on Monday morning?\nOther conversation."),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {(r.conv_id, r.turn): r for r in ql.link_quotes(df).collect()}
    assert got[1, 2].reply_to == 0 and got[1, 2].text == "Yes." and got[1, 2].depth == 1
    assert got[1, 3].reply_to == 2 and got[1, 3].thread_turn == 0 and got[1, 3].depth == 2 and got[1, 3].n_quotes == 2 and got[1, 3].n_linked == 2
    assert got[1, 3].text == "Fine.\nSo it is."
    assert got[1, 4].reply_to is None and got[1, 4].n_quotes == 1 and got[1, 4].text == "Who said this?" and got[1, 4].thread_turn == 4
    assert got[2, 7].reply_to is None and got[2, 7].text == "Other conversation."
    assert got[1, 0].text == rows[0][3] and got[1, 0].n_quotes == 0
    order = sorted((r.path, r.turn) for r in got.values() if r.conv_id == 1)
    assert [t for _, t in order] == [0, 2, 3, 1, 4] and got[1, 3].path == [0, 2, 3]
    built = ql.conversations(df.repartition(5)).collect()
    assert [(r.conv_id, r.turn) for r in built] == [(1, 0), (1, 2), (1, 3), (1, 1), (1, 4), (2, 7)]


def test_a_reply_stands_before_the_next_sibling(spark):
    """Volume: every conversation is a comb of quotes, so branches interleave by turn."""
    rows = []
    for c in range(300):
        rows += [(c, 0, f"the very first words of {c}"), (c, 1, f"> the very first words of {c}\nleft branch says {c}"), (c, 2, f"> the very first words of {c}\nright branch says {c}")]
        rows += [(c, t, f"> {'left' if t % 2 else 'right'} branch says {c}\nleaf {t}") for t in range(3, 13)]
    built = ql.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(7)).collect()
    assert len(built) == len(rows) and sum(r.n_linked for r in built) == 300 * 12
    assert [r.turn for r in built] == [0, 1, 3, 5, 7, 9, 11, 2, 4, 6, 8, 10, 12] * 300


def test_edges(spark):
    assert ql.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 0, "a", "one two three four"), (None, 1, "a", "> one two three four"), (1, None, "a", "> x"), (1, 5, None, None), (1, 6, "a", ""), (1, 6, "a", ""), (1, 7, "a", ">\n>  \n"), (3, 0, "a", ">" * 3000 + " deep\n" + "w " * 100_000)]
    got = ql.link_quotes(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    assert at[None, 1].reply_to == 0 and at[None, 1].text == ""
    assert at[1, None].thread_turn is None and at[1, None].n_quotes == 1 and at[1, 5].text is None and at[1, 7].n_quotes == 1 and at[1, 7].n_linked == 0
    assert ql.link_quotes(spark.createDataFrame([(1, 0, "a")], "conv_id long, turn long, text string")).columns[:3] == ["conv_id", "turn", "text"]


def brute(rows):
    """reply_to, thread, depth by comparing every passage with every earlier message."""
    own = {(c, t): {x: (k, n) for k, n, x in ql.units((ql.split_quotes(text)[0] or "").split("\n"))} for c, t, text in rows}
    parent = {}
    for c, t, text in rows:
        best = []
        for nth, (level, lines) in enumerate(ql.split_quotes(text)[1]):
            hits = [(-k, -n, min(u for (d, u), have in own.items() if d == c and x in have)) for k, n, x in ql.units(lines) if any(d == c and x in have for (d, _), have in own.items())]
            hits = [h for h in hits if h[2] < t]
            if hits:
                best.append((level, nth, min(hits)[2]))
        if best:
            parent[c, t] = (min(best)[2], len(best))
    out = {}
    for c, t, _ in rows:
        path = [t]
        while (c, path[0]) in parent:
            path.insert(0, parent[c, path[0]][0])
        out[c, t] = (*parent.get((c, t), (None, 0)), path[0], len(path) - 1, tuple(path))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    said = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.choice([2, 5, 9]))) for _ in range(12)]
    rows, texts = [], {}
    for c in range(6):
        for t in range(25):
            parts = [rng.choice(said) for _ in range(rng.randrange(1, 4))]
            if t and rng.random() < 0.8:
                quoted = texts[c, rng.randrange(t)].split("\n")
                at = rng.randrange(len(quoted))
                parts = ["> " + x if rng.random() < 0.9 else ">> " + x for x in quoted[at : at + rng.choice([1, 2, 9])]] + [rng.choice(["", "ok"])] + parts
            texts[c, t] = "\n".join(parts)
            rows.append((c, t, texts[c, t]))
    got = ql.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_linked, r.thread_turn, r.depth, tuple(r.path)) for r in got.collect()} == brute(rows)
    assert got.filter(F.col("text").contains(">")).count() == 0
