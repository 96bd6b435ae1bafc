"""URL filters: a trie over reversed host labels, and at each host one over path segments.

The deepest host that has a rule fitting the path wins, and at that host the longest path;
where the same host and path are both allowed and blocked, block wins. A rule fits its host
and every subdomain, if the url's path starts with the rule's. Without a fitting rule the
url is allowed. Null urls and urls without `://` have an empty host and path. Rules are
broadcast in blocks of at most `block_rules`, each looked up on its own, the longest taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


class Trie:
    """Nodes are dicts by label; the key "" of a host node holds its path trie, whose nodes
    are dicts by whole segment and hold (verdict, prefix) of last, unfinished segments."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        self.longest = 0  # last, unfinished segment of any rule
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("." + label, {})
            node = node.setdefault("", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            self.longest = max(self.longest, len(rest))
            if node.get((rest,), ("",))[0] != "block":
                node[(rest,)] = (verdict, host, path)

    def find(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        best = self._under(node, path) or best
        for label in reversed(host.split(".")) if host else ():
            node = node.get("." + label)
            if node is None:
                break
            best = self._under(node, path) or best
        return best

    def _under(self, node: dict, path: str) -> Rule | None:
        node, best, lo = node.get(""), None, 0
        while node is not None:
            end = path.find("/", lo)
            segment = path[lo:] if end < 0 else path[lo:end]
            for size in range(min(len(segment), self.longest), -1, -1):
                if (segment[:size],) in node:
                    best = node[(segment[:size],)]
                    break
            node, lo = node.get("/" + segment) if end >= 0 else None, end + 1
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _look_up(trie: Broadcast) -> Callable[..., Column]:
    @F.pandas_udf("verdict string, host string, path string")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            hits = [trie.value.find(h, p) or (None, None, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(hits, columns=["verdict", "host", "path"], dtype=object)

    return look_up


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", block_rules: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of `pages` (page_id, url)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = []
    for lo in range(0, max(1, len(rules)), block_rules):
        trie = spark.sparkContext.broadcast(Trie(rules[lo : lo + block_rules]))
        hit = f"hit{lo}"
        df = df.withColumn(hit, _look_up(trie)("host", "path"))
        found.append(F.when(F.col(hit).verdict.isNotNull(), F.struct(F.length(F.col(hit).host).alias("h"), F.length(F.col(hit).path).alias("p"), (F.col(hit).verdict == "block").alias("b"), F.concat(F.col(hit).host, F.col(hit).path).alias("rule"))))
    best = found[0] if len(found) == 1 else F.greatest(*found)
    return df.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best").isNull(), default).when(F.col("best.b"), "block").otherwise("allow").alias("verdict"))
