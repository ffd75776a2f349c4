"""URL filter: a trie over reversed host labels, then path segments; the longest matching rule decides.

The rules are a stated list (its size is checked before it is broadcast); every URL walks the trie once, so
the work is linear in the URLs and nothing is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm._common import Scope, ascii_lower, column, saved, table

#: (host, path, verdict) of the production list.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Most bytes of pickled trie that are broadcast; a longer list is applied in parts, one after the other.
MAX_TRIE_BYTES = 64 << 20
BEST = "struct<depth:int,length:int,rule:string,verdict:string>"


class UrlTrie:
    """Nodes are dicts: ('h', label) steps up the host, ('p', segment) down the path; 'ends' holds the remainders of
    rules that end inside a segment, by their text, and 'most' the longest one's length."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(("h", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {})
            node["most"] = max(node.get("most", 0), len(rest))
            if ends.get(rest, (None, "allow"))[1] != "block":  # of two verdicts for one rule, block stands
                ends[rest] = (host + path, verdict)

    def longest(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """The rule's host labels and length, the rule and its verdict: the deepest host first, then the longest path."""
        node, hosts = self.root, [self.root]
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for depth in range(len(hosts) - 1, -1, -1):
            node, best = hosts[depth], None
            for segment in segments:
                if ends := node.get("ends"):  # the longest remainder that the segment begins with
                    begun = (ends.get(segment[:k]) for k in range(min(len(segment), node["most"]), -1, -1))
                    best = next(filter(None, begun), best)
                node = node.get(("p", segment))
                if node is None:
                    break
            if best:
                return depth, len(best[0]), *best
        return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to '?', '#' or the
    end. A null url, or one without '://', has an empty host and path."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def judge_urls(df: DataFrame, url: str, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict after its own columns (a column of such a name is replaced).

    Edge cases: a null or odd url fits no rule and gets `default`; repeated rows are judged alike; an empty table
    gives an empty result; other columns pass through. A list whose trie is over MAX_TRIE_BYTES is cut into parts below
    that; each is broadcast and applied in turn, and the best rule of all parts stands.
    """
    with Scope() as scope:
        out, parts = _judged(df, url, list(rules), default)
        # what lies between parts goes with the scope; a single part needs no table
        return scope.result(out, "url-result") if parts > 1 else out


def _judged(df: DataFrame, url: str, rules: list[tuple[str, str, str]], default: str) -> tuple[DataFrame, int]:
    parts = 1 + len(pickle.dumps(UrlTrie(rules))) // MAX_TRIE_BYTES
    best = F.lit(None).cast(BEST)
    host, path = host_and_path(column(url))
    told = F.struct(host.alias("host"), path.alias("path"))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    own = F.struct(*map(column, kept), F.lit(0)).alias("own")  # in one struct, so that no name of theirs meets one of ours
    out = df.select(own, told.alias("url"), best.alias("best"))
    for k in range(parts):
        found = _walk(df.sparkSession, UrlTrie(rules[k::parts]))("url.host", "url.path")
        # greatest() ignores nulls; of two verdicts for one rule, "block" is the greater
        out = out.withColumn("best", F.greatest("best", found) if k else found)
        if parts > 1:  # so that no task holds two tries
            out = saved(out, "url-part")
    verdict = F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    return out.select(*(F.col("own")[c].alias(c) for c in kept), "url.host", "url.path", "best.rule", verdict), parts


def _walk(spark: SparkSession, trie: UrlTrie) -> Callable[[str, str], Column]:
    held = spark.sparkContext.broadcast(trie)

    @F.pandas_udf(BEST)
    def walk(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [held.value.longest(h, p) or (None, None, None, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["depth", "length", "rule", "verdict"]).astype({"depth": "Int32", "length": "Int32"})

    return walk


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url").drop("url")


OP4_SQL = r"""
with u as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), r as (
  select *, case
    when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
    when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
    when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
    when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
    when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/'
  end as rule
  from u
)
select page_id, host, path, rule,
       case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
from r
"""
