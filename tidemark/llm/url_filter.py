"""URL filters: a trie over reversed host labels, then path segments, sent to every task.

Each url gets the rule of the longest match: first the longest host (most labels), then the
longest path. An allow entry may so lie inside a blocked host and the other way round. The
same (host, path) in both lists counts as blocked.

The trie counts its bytes as it grows and is broadcast up to MAX_TRIE_BYTES; larger rule lists
are joined on host suffixes, where Spark's adaptive execution splits suffixes that many urls share.

Edge cases: null urls and urls without "://" have empty host and path, fit no rule and get the
default verdict; repeated rows are judged alike; an empty table gives an empty result; all
columns of the input but those named host, path, rule, verdict are passed through.
"""

from __future__ import annotations

import sys
from bisect import insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, fresh, read

#: The trie is broadcast up to this many bytes of a worker; beyond it judge() joins on host suffixes.
MAX_TRIE_BYTES = 200_000_000


def split_rule(rule: str) -> tuple[str, str]:
    """'example.net/en/' -> ('example.net', '/en/')."""
    host, slash, path = rule.partition("/")
    return host.strip(".").lower(), slash + path


class UrlTrie:
    """Labels from the top-level domain down, then whole path segments.

    Nodes are numbers and edges entries of two flat tables, so a rule of any depth can be pickled. A rule's last
    piece may be a part of a segment (or empty, after a slash); these tails hang at the node of the segments before
    them, with their lengths.
    """

    def __init__(self) -> None:
        self.hosts: dict[tuple[int, str], int] = {}
        self.segments: dict[tuple[int, str], int] = {}
        #: host node -> its first path node; path node -> lengths of its tails; (path node, tail) -> (rule, verdict)
        self.paths: dict[int, int] = {}
        self.lengths: dict[int, list[int]] = {}
        self.tails: dict[tuple[int, str], tuple[str, str]] = {}
        self.nodes = self.bytes = 0

    def _grow(self, *objects: object) -> None:
        self.bytes += sum(map(sys.getsizeof, objects)) + 64  # 64: a place in a table

    def _step(self, table: dict[tuple[int, str], int], node: int, piece: str) -> int:
        key = (node, piece)
        if key not in table:
            self.nodes += 1
            table[key] = self.nodes
            self._grow(key, piece, node, self.nodes)
        return table[key]

    def add(self, rule: str, verdict: str) -> None:
        host, path = split_rule(rule)
        node = 0
        for label in reversed(host.split(".")):
            node = self._step(self.hosts, node, label)
        if node not in self.paths:
            self.nodes += 1
            self.paths[node] = self.nodes
            self._grow(node, self.nodes)
        node = self.paths[node]
        *segments, tail = path.split("/")
        for segment in segments:
            node = self._step(self.segments, node, segment)
        if self.tails.get((node, tail), ("", ""))[1] != "block":
            lengths = self.lengths.setdefault(node, [])
            if len(tail) not in lengths:
                insort(lengths, len(tail))
            self.tails[node, tail] = (host + path, verdict)
            self._grow((node, tail), tail, (0, 0), host + path, lengths, 0)

    def _longest(self, node: int, pieces: list[str]) -> tuple[str, str] | None:
        best = None
        for piece in pieces:
            for length in reversed(self.lengths.get(node, ())):
                if length <= len(piece) and (hit := self.tails.get((node, piece[:length]))):
                    best = hit
                    break
            node = self.segments.get((node, piece))
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        node, found = 0, []
        for label in reversed(host.split(".")):
            node = self.hosts.get((node, label))
            if node is None:
                break
            if node in self.paths:
                found.append(self.paths[node])
        pieces = path.split("/")
        for node in reversed(found):
            hit = self._longest(node, pieces)
            if hit:
                return hit
        return None


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path, both empty for null or without '://'."""
    part = lambda group: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return pages.withColumns({"host": ascii_lower(part(1)), "path": part(2)})


def judge(
    pages: DataFrame,
    block: Iterable[str],
    allow: Iterable[str],
    default: str = "allow",
    url: str = "url",
    max_trie_bytes: int = MAX_TRIE_BYTES,
) -> DataFrame:
    """Adds host, path, rule (null without a match) and verdict ('allow' or 'block')."""
    rules = [(r, "allow") for r in allow] + [(r, "block") for r in block]
    df = with_host_path(pages.drop("rule", "verdict"), url)
    trie = UrlTrie()
    for rule, verdict in rules:
        trie.add(rule, verdict)
        if trie.bytes > max_trie_bytes:
            return _judge_by_join(df, rules, default)
    shared = pages.sparkSession.sparkContext.broadcast(trie)
    (found,) = fresh([*df.columns, "rule", "verdict"], "found")

    @F.pandas_udf("rule string, verdict string")
    def matched(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        match = shared.value.match
        return pd.DataFrame([match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    hit = df.withColumn(found, matched("host", "path"))
    return hit.withColumns({"rule": F.col(found)["rule"], "verdict": F.col(found)["verdict"]}).drop(found)


def _judge_by_join(df: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """For rule lists too large to broadcast: join each host's suffixes with the rules.

    Distinct (host, path) pairs are matched and joined back, so a popular host costs its
    distinct paths only.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(*split_rule(r), v) for r, v in rules], "rule_host string, rule_path string, rule_verdict string")
    table = table.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    labels = F.split("host", r"\.")
    keys = df.select("host", "path").distinct()
    suffixes = keys.withColumn("at_", F.explode(F.sequence(F.lit(1), F.size(labels)))).withColumn("suffix_", F.array_join(F.slice(labels, F.col("at_"), 1 << 30), "."))
    best = (
        suffixes.join(table, (F.col("suffix_") == F.col("rule_host")) & F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct(-F.col("at_"), F.length("rule_path"))).alias("hit_"))
    )
    same = (F.col("d.host") == F.col("b.host")) & (F.col("d.path") == F.col("b.path"))
    joined = df.alias("d").join(best.alias("b"), same, "left")
    return joined.select("d.*", F.col("b.hit_.rule").alias("rule"), F.coalesce("b.hit_.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page; default verdict: allow."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         row_number() OVER () AS row_id
  FROM pages),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (
  SELECT row_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (row_id)
"""
