"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet into the shared folder and read again, so a lost executor costs one stage at
most. All stages but the last return the columns of documents, all of them untouched but for
text, n_chars and the rows' number. Nulls, empty texts, repeated rows, empty tables and columns
that documents may have besides go through as the operators' docstrings say; the last stage
returns doc_id, lang, source and its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_automaton, jaccard_join, line_dedup, mixing, quality_rules
from tidemark.llm.common import discard, durable, read, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified cutoffs keep."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later runs of repeated lines."""
    return line_dedup.cleaned_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five words, similarity 0.8)."""
    return jaccard_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded of every document of the mix."""
    out = bpe_automaton.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), bpe_automaton.default_path())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("BPE", tokens)]

#: BPE and the certified cutoffs of a stage's own input are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's tables go when it is done, its input when the next one is."""
    docs = read(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        with scratch() as kept:
            done = durable(stage(spark, docs, sf_dir))
            kept.append(done)
        if place:
            discard(docs)
        docs = done
    return docs
