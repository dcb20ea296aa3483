"""Quality rules with risk-controlled thresholds.

A document's score is the largest of four shares (symbols, capitals, repeated words, repeated
lines). Strata are the languages of the labelled clean documents. In a stratum these documents
are the holdout, each different text once, as copies are no independent draws: n of them, k of
which score above a cutoff. The cutoff is certified if the exact binomial tail
P(Bin(n, max_false_rejection) <= k) is at most the level. Cutoffs are tested from the most lenient
one downwards until one fails (fixed-sequence testing, which needs no correction for their
number), and strata share the error equally (Bonferroni): level = error / strata. The last
certified cutoff of a stratum is used, so with probability 1 - error no stratum loses more than
max_false_rejection of its clean documents to the cutoffs. Strata without a certified cutoff
reject nothing by it.

Counts by stratum are aggregates, tests run in tasks, and documents meet their stratum's cutoff
in a join, so the number of strata is not limited.

Edge cases: a null or empty text has no words and fails the base rule; a null language is that
of the empty name; repeated rows are judged alike; of labels for one document or text the lowest
quality counts, and null labels say nothing; without labels no cutoff is certified; other columns, whatever their names, are
ignored or passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, durable, fresh, pieces, read

SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: In the order of the tests.
CUTOFFS = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3)
MAX_FALSE_REJECTION = 0.01
ERROR = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")


def repeated_words(tokens: list[bytes]) -> int:
    """Number of words that lie in a 3-word window found twice or more in the text."""
    n = len(tokens)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int64, n)
    pairs = a[:-1] * len(ids) + a[1:]
    if len(ids) >= 2_000_000:  # the product of three ids would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    text = text or ""
    raw = text.encode()
    tokens = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    return (
        len(tokens),
        len(text) - (len(raw) - len(raw.translate(None, ASCII_SPACE))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(tokens),
        len(raw) - len(raw.translate(None, CAPITALS)),
        len(lines),
    )


def with_counts(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs (with a column text) and the values of COUNTS under these names, in the order of the input."""
    # columns go by number into the task, as names may hold any character
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", {c} long" for c in COUNTS)
    text_at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([counts_of(t.as_py()) for t in batch.column(text_at)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, j]) for j in range(len(COUNTS)))], names=[*batch.schema.names, *COUNTS])

    return rows.mapInArrow(add, schema).toDF(*docs.columns, *names)


def base_failed(of: dict[str, str]) -> Column:
    """The base rule; of: the names that columns of COUNTS have."""
    n_words = F.col(of["n_words"])
    return (n_words < MIN_WORDS) | (100 * F.col(of["n_repeat_words"]) > MAX_REPEAT_PERCENT * n_words)


def score(of: dict[str, str]) -> Column:
    """The largest share; 0 without words."""
    per = lambda part, whole, times=1.0: times * F.col(of[part]).cast("double") / F.greatest(F.col(of[whole]), F.lit(1)).cast("double")
    return F.greatest(per("n_symbols", "word_chars", 4.0), per("n_capitals", "word_chars"), per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"))


def stratum() -> Column:
    return F.coalesce("lang", F.lit(""))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k) for k <= n p, summed from its largest term downwards to the last that counts."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total, term = 0.0, math.exp(log(k))
    for i in range(k, -1, -1):
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        if term < total * 1e-17:
            break
    return min(1.0, total)


def certified(ks: list[int], n: int, risk: float, level: float) -> float | None:
    """The last of CUTOFFS before the first that fails; ks: clean documents above each. A tail with k > risk * n is no small one."""
    last = None
    for cutoff, k in zip(CUTOFFS, ks, strict=True):
        if k > risk * n or binomial_tail(k, n, risk) > level:
            break
        last = cutoff
    return last


def fit_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = MAX_FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """The durable table (stratum, cutoff) of strata with a certified cutoff, from all labelled documents.

    counted: doc_id, lang, text_key and COUNTS.
    """
    own = dict(zip(COUNTS, COUNTS, strict=True))
    quality = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = counted.select("doc_id", "text_key", stratum().alias("stratum"), score(own).alias("score")).join(quality, "doc_id")
    texts = texts.groupBy("stratum", "text_key").agg(F.min("quality").alias("quality"), F.max("score").alias("score")).filter("quality = 1")
    found = texts.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col("score") > c).alias(f"k{j}") for j, c in enumerate(CUTOFFS)))
    found = found.withColumn("strata", F.count("*").over(Window.partitionBy()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cutoffs = [certified([int(row[f"k{j}"]) for j in range(len(CUTOFFS))], int(row["n"]), risk, error / int(row["strata"])) for row in frame.to_dict("records")]
            yield pd.DataFrame({"stratum": frame["stratum"], "cutoff": cutoffs}, columns=["stratum", "cutoff"]).dropna()

    return durable(found.mapInPandas(run, "stratum string, cutoff double"))


def judged(counted: DataFrame, of: dict[str, str], cutoffs: DataFrame, name: str) -> DataFrame:
    """Adds the boolean `name`: true for documents that the base rule and the cutoffs keep."""
    (cutoff,) = fresh([*counted.columns, name], "cutoff")
    met = counted.alias("d").join(cutoffs.alias("c"), F.coalesce("d.lang", F.lit("")) == F.col("c.stratum"), "left")
    met = met.select(*(F.col(f"d.`{c}`") for c in counted.columns), F.col("c.cutoff").alias(cutoff))
    return met.withColumn(name, ~base_failed(of) & F.coalesce(score(of) <= F.col(cutoff), F.lit(True))).drop(cutoff)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts of all documents (doc_id, lang, text_key, COUNTS), written once, and the certified cutoffs."""
    counted = with_counts(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_key")), list(COUNTS)).drop("text")
    counted = durable(counted)
    return counted, fit_cutoffs(counted, labels)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with their columns. Texts are read twice and never shuffled."""
    _, cutoffs = fit(docs, labels)
    *names, kept = fresh(docs.columns, *COUNTS, "kept")
    out = judged(with_counts(docs, names), dict(zip(COUNTS, names, strict=True)), cutoffs, kept)
    return out.filter(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    counted, cutoffs = fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    own = dict(zip(COUNTS, COUNTS, strict=True))
    out = judged(counted, own, cutoffs, "kept")
    return out.select("doc_id", *COUNTS[:5], base_failed(own).alias("base_failed"), score(own).alias("score"), "kept")


OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
tri AS (SELECT row_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT row_id, count(DISTINCT i + s) AS n FROM dup, (VALUES (0), (1), (2)) v(s) GROUP BY row_id),
ln AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (SELECT row_id, count(*) AS n, count(DISTINCT line) AS d FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
c AS (
  SELECT row_id, doc_id, lang, text, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs JOIN w USING (row_id) LEFT JOIN lines USING (row_id) LEFT JOIN rep USING (row_id)),
s AS (
  SELECT *, coalesce(lang, '') AS stratum,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         greatest(4.0::DOUBLE * n_symbols::DOUBLE / greatest(word_chars, 1)::DOUBLE, n_capitals::DOUBLE / greatest(word_chars, 1)::DOUBLE,
                  n_repeat_words::DOUBLE / greatest(n_words, 1)::DOUBLE, n_dup_lines::DOUBLE / greatest(n_lines, 1)::DOUBLE) AS score
  FROM c),
clean AS (
  SELECT stratum, text, max(score) AS score FROM s JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  GROUP BY stratum, text HAVING min(quality) = 1),
tests AS (
  SELECT stratum, cutoff, count(*) AS n, count(*) FILTER (WHERE score > cutoff) AS k, (SELECT count(DISTINCT stratum) FROM clean) AS strata
  FROM clean, (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) v(cutoff) GROUP BY stratum, cutoff),
tails AS (
  SELECT stratum, cutoff, strata, CASE WHEN k > 0.01::DOUBLE * n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END AS tail FROM tests),
failed AS (SELECT stratum, max(cutoff) FILTER (WHERE tail > 0.05 / strata) AS cutoff FROM tails GROUP BY stratum),
cut AS (SELECT tails.stratum, min(tails.cutoff) AS cutoff FROM tails JOIN failed USING (stratum) WHERE tails.cutoff > coalesce(failed.cutoff, 0) GROUP BY tails.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
       NOT base_failed AND coalesce(score <= cutoff, TRUE) AS kept
FROM s LEFT JOIN cut USING (stratum)
"""
