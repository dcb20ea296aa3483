"""Line dedup by winnowing over line hashes.

A text is its \\n-split lines that hold a word; a line counts as its words. From every line a
window reaches forwards to the first line with which it holds min_words words (none, if the text
ends before), and another backwards likewise; those that are equal count once. The minimum of a
window - the line with the most words, ties to the smaller hash - is its fingerprint. Windows
that overlap mostly share it, so fingerprints are sparse. Whether a stretch of lines is a window
and which line is its minimum depends on these lines alone, so a run of min_words words or more
that stands in two places has the same fingerprints in both: they are guaranteed.

1. Fingerprints are counted by place; those that stand in one place only can't be in a repeated
   run and go, with their windows.
2. The positions that are left are joined: each window around a fingerprint that repeats meets
   the first place (by doc_id, then by line) of the same window. A line that is common elsewhere
   can't hide a run this way, and a window costs one row, however often it repeats.
3. Matches are extended both ways. The windows forwards and backwards cover a run of min_words
   words or more wholly: of the words up to a line's end, those from its start, or all of the
   run, one holds a window with that line. So matches with the same first document and distance
   that overlap or touch grow together to the maximal run, line by line.
4. Later runs are deleted, the first stays: a line goes exactly if it lies in a run of min_words
   words or more that also stands at an earlier place.

A fingerprint found everywhere is one key of a join against one row; Spark's adaptive execution
splits such keys. A document's matches are at most twice its lines.

Edge cases: null and empty texts have no lines and come back as they are; texts without repeated
runs are untouched; else the lines left (blank ones too) are joined by \\n, and the text may become
empty; a run may repeat within one text; null doc_ids come last; rows with the same doc_id and
text are the same place, so all of them keep or lose the same lines; other columns, whatever their
names, are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, fresh, n_words, pieces, read

MIN_WORDS = 50


def word_lines(text: str | None) -> list[tuple[int, int, bytes]]:
    """(line number, number of words, hash) of the lines with words."""
    out = []
    for number, line in enumerate(text.encode().split(b"\n") if text else ()):
        words = line.split()
        if words:
            out.append((number, len(words), xxhash.xxh3_128_digest(b" ".join(words))))
    return out


def windows(lines: list[tuple[int, int, bytes]], min_words: int) -> list[tuple[int, int, int, bytes]]:
    """(first, last, minimum, key) of each window, as places in lines; key: hash of the window."""
    out = []

    def add(start: int, stop: int) -> None:
        least = min(range(start, stop), key=lambda i: (-lines[i][1], lines[i][2], i))
        key = xxhash.xxh3_128_digest(b"".join(x[2] for x in lines[start:stop]))
        out.append((start, stop - 1, least, key))

    stop, held = 0, 0
    for start in range(len(lines)):
        while stop < len(lines) and held < min_words:
            held += lines[stop][1]
            stop += 1
        if held < min_words:
            break
        add(start, stop)
        held -= lines[start][1]
    start, held = 0, 0
    for last in range(len(lines)):
        held += lines[last][1]
        while held - lines[start][1] >= min_words:
            held -= lines[start][1]
            start += 1
        # else the window is one of those above
        if held - lines[last][1] >= min_words:
            add(start, last + 1)
    return out


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, mark, at, windows: one row for each line that is the minimum of a window.

    mark: hash of that line; at: its place; windows: those that it is the minimum of, as (first,
    last, key), where key is the hash of the window's lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for doc_id, own, text in zip(batch.column("doc_id"), batch.column("text_key"), batch.column("text"), strict=True):
                lines = word_lines(text.as_py())
                around: dict[int, list[dict]] = {}
                for first, last, at, key in windows(lines, min_words):
                    around.setdefault(at, []).append({"first": first, "last": last, "key": key})
                rows += [(doc_id.as_py(), own.as_py(), lines[at][2], at, found) for at, found in around.items()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            window = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("key", pa.binary())])
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(window))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_key", "mark", "at", "windows"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").filter("text <> ''")
    return rows.mapInArrow(run, "doc_id long, text_key long, mark binary, at int, windows array<struct<first:int,last:int,key:binary>>")


def _place(*inside: str) -> Column:
    """Orders places: by doc_id, nulls last, then by text and line."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", *inside)


def later_matches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, first, last and the earlier place: from_doc, from_text, from_first."""
    prints = durable(fingerprints(docs, min_words))
    marks = prints.select("mark", _place("at").alias("place")).groupBy("mark").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low <> high").select("mark")
    around = durable(prints.join(marks, "mark").select("doc_id", "text_key", F.inline("windows")))
    place = _place("first")
    firsts = around.select("key", place.alias("place")).groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low <> high").select("key", F.col("low").alias("place"))
    joined = around.join(firsts, "key").filter(place != F.col("place"))
    return joined.select("doc_id", "text_key", "first", "last", F.col("place.doc_id").alias("from_doc"), F.col("place.text_key").alias("from_text"), F.col("place.first").alias("from_first"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, first, last, from_doc, from_first: the maximal later runs, one row each.

    Lines are counted among those that hold words.
    """
    shift = (F.col("first") - F.col("from_first")).alias("shift")
    matches = later_matches(docs, min_words).select("doc_id", "text_key", "from_doc", "from_text", shift, "first", "last").distinct()
    line = Window.partitionBy("doc_id", "text_key", "from_doc", "from_text", "shift").orderBy("first", "last")
    reach = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    grown = matches.withColumn("opens", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = grown.groupBy("doc_id", "text_key", "from_doc", "from_text", "shift", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.select("doc_id", "text_key", "first", "last", "from_doc", (F.col("first") - F.col("shift")).alias("from_first"))


def without_runs(docs: DataFrame, min_words: int, n_deleted: str, deleted_words: str) -> DataFrame:
    """docs with the later runs' lines deleted, and the numbers of lines and words deleted under these names."""
    (key,) = fresh(docs.columns, "text_key")
    runs = repeated_runs(docs, min_words).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    # columns go by number into the task, as names may hold any character
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)) + ", lines long, words long"
    text_at, n_columns = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, lines_gone, words_gone = [], [], []
            for text, found in zip(batch.column(text_at), batch.column(n_columns), strict=True):
                text, found = text.as_py(), found.as_py()
                gone: dict[int, int] = {}
                if found:
                    lines = word_lines(text)
                    gone = {lines[i][0]: lines[i][1] for r in found for i in range(r["first"], r["last"] + 1)}
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                texts.append(text)
                lines_gone.append(len(gone))
                words_gone.append(sum(gone.values()))
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(n_columns)]
            columns += [pa.array(lines_gone, pa.int64()), pa.array(words_gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n_columns], "lines", "words"])

    keyed = docs.withColumn(key, F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.col(f"d.`{key}`") == F.col("r.text_key"))
    joined = keyed.join(runs.alias("r"), same, "left").select(*(F.col(f"d.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), "r.runs")
    return joined.mapInArrow(run, schema).toDF(*docs.columns, n_deleted, deleted_words)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later runs' lines deleted, and n_deleted (lines) and deleted_words added (in place of columns named so)."""
    return without_runs(docs.drop("n_deleted", "deleted_words"), min_words, "n_deleted", "deleted_words")


def cleaned_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later runs' lines deleted; n_chars follows the text; all other columns are untouched."""
    lines, words = fresh(docs.columns, "n_deleted", "deleted_words")
    out = without_runs(docs, min_words, lines, words)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lines) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(lines, words)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", n_words(F.col("text")).alias("n_words"), "n_deleted", "deleted_words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP9_SQL = r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM raw),
w AS (SELECT doc_id, number, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS norm FROM split),
l AS (SELECT doc_id, number, n, norm, row_number() OVER d AS i, sum(n) OVER d AS upto FROM w WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY number)),
s AS (SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY a.doc_id, a.i
      UNION SELECT b.doc_id, max(a.i) AS first, b.i AS last FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.i),
k AS (SELECT s.doc_id, s.first, s.last, string_agg(l.norm, chr(10) ORDER BY l.i) AS key FROM s JOIN l ON l.doc_id = s.doc_id AND l.i BETWEEN s.first AND s.last GROUP BY ALL),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, first) AS nth FROM k) WHERE nth > 1),
gone AS (SELECT DISTINCT l.doc_id, l.number, l.n FROM l JOIN later ON l.doc_id = later.doc_id AND l.i BETWEEN later.first AND later.last),
left_over AS (
  SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.number) FILTER (WHERE gone.number IS NULL) AS text,
         CAST(count(gone.number) AS BIGINT) AS n_deleted, CAST(coalesce(sum(gone.n), 0) AS BIGINT) AS deleted_words,
         CAST(coalesce(sum(w.n) FILTER (WHERE gone.number IS NULL), 0) AS BIGINT) AS n_words
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.number = gone.number GROUP BY w.doc_id)
SELECT doc_id, n_words, n_deleted, deleted_words, sha256(coalesce(text, '')) AS text_sha256 FROM left_over
"""
