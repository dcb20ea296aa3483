"""Chat formatting by quotation linking.

Parsing. A line's quote level is the number of > before it. Lines of one level that follow each
other are a passage; level 0 is the message's own text. Lines that announce a quotation ("...
wrote:") right before one are no own text either.

Linking. Passages and own texts are normalised (lower case, white space as one space) and hashed
in units: the whole, its paragraphs, and its lines of at least MIN_LINE_WORDS words. A passage's
original is the first message of the conversation whose own text holds the unit; it must stand
before the quoting message. Of a passage's units the whole counts most, then paragraphs, then
lines, then more words. A message replies to the original of its passage with the lowest level,
then of the first one. First messages of a unit are found by an aggregation, so a line that many
messages hold is one row when it meets the quotes.

Ordering. A message's position is its path: the turns from its thread's first message down to
itself, found by doubling the steps along the replies. Paths sort thread by thread, each reply
after its original and before the original's next reply, so conversations() builds the
reply-ordered conversations, without quotes, by one distributed sort; a conversation with a third
of all messages is spread over many tasks. A path takes the place of its depth.

Edge cases: null and empty texts have no passages and come back as they are, as do texts without
quotes; blank quotes link with nothing; a null conversation is one of its own; rows with a null
turn never link and are their own thread; repeated rows are one message and each row is
returned; passages quoted from nowhere are removed from the text and not linked; an empty table
gives an empty result; other columns are passed through, those named as the new ones replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable, n_words, read

MIN_LINE_WORDS = 4
LINE, PARAGRAPH, WHOLE = 1, 2, 3
MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)")
#: Ends of lines that announce a quotation, in four languages (fixed values).
ANNOUNCES = re.compile(r".*\b(wrote|writes|schrieb|schreibt|écrit|escribió)\b[^:]*:\s*$", re.I)


def leveled(text: str) -> list[tuple[int, str]]:
    """(quote level, rest) of each line."""
    out = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def split_quotes(text: str | None) -> tuple[str | None, list[tuple[int, list[str]]]]:
    """The text without quotes, and the passages (level, lines) in their order."""
    if not text or ">" not in text:
        return text, []
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for level, line in leveled(text):
        if level and level == before:
            passages[-1][1].append(line)
        elif level:
            if not before:
                while own and not own[-1].strip():
                    own.pop()
                if own and ANNOUNCES.match(own[-1]):
                    own.pop()
            passages.append((level, [line]))
        elif before and not line.strip():
            continue  # blank lines after a quotation belong to it
        else:
            own.append(line)
        before = level
    return ("\n".join(own).strip("\n"), passages) if passages else (text, [])


def units(lines: list[str]) -> list[tuple[int, int, str]]:
    """(kind, words, normalised text) of the whole, the paragraphs and the lines."""
    clean = [x.lower().split() for x in lines]
    found: dict[str, tuple[int, int]] = {}

    def add(kind: int, words: list[str]) -> None:
        if words and (kind > LINE or len(words) >= MIN_LINE_WORDS):
            text = " ".join(words)
            found[text] = max(found.get(text, (0, 0)), (kind, len(words)))

    paragraph: list[str] = []
    for words in [*clean, []]:
        add(LINE, words)
        if not words:
            add(PARAGRAPH, paragraph)
            paragraph = []
        paragraph = paragraph + words
    add(WHOLE, [w for words in clean for w in words])
    return [(kind, n, text) for text, (kind, n) in found.items()]


def _key(*parts: object) -> bytes:
    return xxhash.xxh3_128_digest("\0".join("null" if p is None else f"={p}" for p in parts).encode())


def with_own_text(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages without quotes in text, with message (a key) and n_quotes added."""
    kept = [c for c in messages.columns if c not in ("message", "n_quotes")]
    messages = messages.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields) + ", message binary, n_quotes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(conversation).to_pylist(), batch.column(turn).to_pylist(), batch.column(text).to_pylist(), strict=True))
            split = [split_quotes(t) for _, _, t in rows]
            new = {text: pa.array([own for own, _ in split], pa.string()), "message": pa.array([_key(*r) for r in rows], pa.binary()), "n_quotes": pa.array([len(p) for _, p in split], pa.int64())}
            names = [*kept, "message", "n_quotes"]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return messages.mapInArrow(run, schema)


def unit_table(messages: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """message, turn, nth (null for own text), level, kind, words, key: all units of all messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c, t, x in zip(batch.column("c").to_pylist(), batch.column("t").to_pylist(), batch.column("x").to_pylist(), strict=True):
                if not x:
                    continue
                message = _key(c, t, x)
                own, passages = split_quotes(x)
                out += [(message, t, None, 0, kind, n, _key(c, unit)) for kind, n, unit in units((own or "").split("\n"))]
                for nth, (level, lines) in enumerate(passages):
                    out += [(message, t, nth, level, kind, n, _key(c, unit)) for kind, n, unit in units(lines)]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["message", "turn", "nth", "level", "kind", "words", "key"])

    source = messages.select(F.col(conversation).alias("c"), F.col(turn).cast("long").alias("t"), F.col(text).alias("x")).filter("t is not null")
    return source.mapInArrow(run, "message binary, turn long, nth int, level int, kind int, words long, key binary")


def replies(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """message, reply_to (turn), n_linked (passages), thread_turn, depth, above (turns of the path before the message's own): one row for each message with a linked quote."""
    every = durable(unit_table(messages, conversation, turn, text))
    firsts = every.filter("nth is null").groupBy("key").agg(F.min(F.struct("turn", "message")).alias("first"))
    quotes = every.filter("nth is not null")
    found = quotes.join(firsts, "key").filter(F.col("first.turn") < F.col("turn"))
    passages = found.groupBy("message", "nth", "level").agg(F.min(F.struct((-F.col("kind")).alias("k"), (-F.col("words")).alias("w"), "first")).alias("best"))
    parents = passages.groupBy("message").agg(F.min(F.struct("level", "nth", "best.first")).alias("best"), F.count("*").alias("n_linked"))
    links = durable(parents.select("message", "n_linked", F.col("best.first.turn").alias("reply_to"), F.col("best.first.message").alias("up")))
    # above: the turns from `up` down to the message's original
    steps = durable(links.select("message", "up", F.array("reply_to").alias("above")))
    while True:
        further = steps.select(F.col("message").alias("at"), F.col("up").alias("next"), F.col("above").alias("more"))
        grown = durable(
            steps.join(further, F.col("up") == F.col("at"), "left").select(
                "message", F.coalesce("next", "up").alias("up"), F.when(F.col("more").isNull(), F.col("above")).otherwise(F.concat("more", "above")).alias("above"), F.col("next").isNotNull().alias("moved")
            )
        )
        discard(steps)
        steps, moved = grown, grown.filter("moved").limit(1).count()
        if not moved:
            break
    placed = steps.select("message", F.col("above")[0].alias("thread_turn"), F.size("above").cast("long").alias("depth"), "above")
    return links.drop("up").join(placed, "message")


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages without quotes, and n_quotes, n_linked, reply_to, thread_turn, depth, path."""
    added = ("n_linked", "reply_to", "thread_turn", "depth", "path", "above")
    own = with_own_text(messages.drop(*added), conversation, turn, text)
    return _place(own, replies(messages, conversation, turn, text), turn)


def conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The rows of link_quotes() in the order of conversations and, inside, of replies; null turns come first."""
    return link_quotes(messages, conversation, turn, text).orderBy(conversation, "path")


def _place(own: DataFrame, links: DataFrame, turn: str) -> DataFrame:
    out = own.join(links, "message", "left").drop("message")
    out = out.withColumn("path", F.concat(F.coalesce("above", F.array().cast("array<long>")), F.array(F.col(turn).cast("long")))).drop("above")
    return out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "thread_turn": F.coalesce("thread_turn", F.col(turn).cast("long")), "depth": F.coalesce("depth", F.lit(0)).cast("long")})


def op2_quote_links(spark, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "conversations")
    # digests are taken before the join, so texts are never shuffled
    own = with_own_text(messages).select("conv_id", "turn", "role", "message", "n_quotes", n_words(F.col("text")).alias("n_words"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    placed = _place(own, replies(messages), "turn")
    return placed.select("conv_id", "thread_turn", "turn", "role", "reply_to", "depth", "path", "n_quotes", "n_linked", "n_words", "text_sha256")
