"""URL filters: a trie over reversed host labels and path segments, the longest rule wins."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Rules of one trie (some hundred bytes each); a longer list is matched trie by trie.
RULES_PER_TRIE = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """``example.net/en/`` is host ``example.net`` and path prefix ``/en/``."""
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


class Trie:
    """Nodes are dicts: host labels from the last to the first, then path segments.

    A rule sits at its last node.  Its last path segment may be a part of the url's segment, so a node
    holds the rules that end there by that last part (``ends``), longest first.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("host", label), {})
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(("path", segment), {})
            node.setdefault("ends", {}).setdefault(last, (len(rule), rule, verdict))

    @staticmethod
    def _better(found, node: dict, segment: str):
        ends = node.get("ends")
        if ends:
            for size in range(min(len(segment), max(map(len, ends))), -1, -1):
                hit = ends.get(segment[:size])
                if hit and (found is None or hit > found):
                    found = hit
                if hit:
                    break
        return found

    def match(self, host: str, path: str):
        """The longest rule that fits, as ``(length, rule, verdict)``; of equally long ones the last by name."""
        found, node = None, self.root
        segments = path.split("/")
        for label in [None, *(reversed(host.split(".")) if host else ())]:
            if label is not None:
                node = node.get(("host", label))
                if node is None:
                    break
            inner = node
            for segment in segments:
                found = self._better(found, inner, segment)
                inner = inner.get(("path", segment))
                if inner is None:
                    break
        return found


class SharedTrie:
    """What is broadcast: rules, whose trie each worker builds once and keeps for all its batches and tasks."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules, self._trie = rules, None

    def trie(self) -> Trie:
        if self._trie is None:
            self._trie = Trie(self.rules)
        return self._trie


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest fitting one or null) and ``verdict``.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's
    path; a rule without a path fits any.  The longest rule wins over shorter ones, whatever their
    verdicts; no fitting rule gives ``default``.  A rule given twice, also with a host in other letter case, must have
    one verdict; of such spellings the first in code-point order is reported.  Tries of at most ``RULES_PER_TRIE`` rules are broadcast and matched one after the other, so a list of any
    length gives the same answer.  Null urls have empty host and path.  Columns of ``pages`` named
    like the new ones are replaced; repeated rows are judged alike.
    """
    verdicts: dict[tuple[str, str], str] = {}
    spelt: dict[tuple[str, str], str] = {}
    for rule, verdict in sorted(rules):
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"verdict of {rule!r} is neither {ALLOW} nor {BLOCK}")
        spelt.setdefault(split_rule(rule), rule)
        if verdicts.setdefault(split_rule(rule), verdict) != verdict:
            raise ValueError(f"{rule!r} is both {ALLOW} and {BLOCK}")
    ordered = sorted((spelt[key], verdict) for key, verdict in verdicts.items())
    sc = pages.sparkSession.sparkContext
    best = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    for i in range(0, len(ordered), RULES_PER_TRIE):
        shared = sc.broadcast(SharedTrie(ordered[i : i + RULES_PER_TRIE]))

        @F.pandas_udf("struct<size:int,rule:string,verdict:string>")
        def longest(host: pd.Series, path: pd.Series) -> pd.DataFrame:
            trie = shared.value.trie()
            seen: dict = {}
            rows = []
            for key in zip(host, path):
                if key not in seen:
                    seen[key] = trie.match(*key) or (None, None, None)
                rows.append(seen[key])
            frame = pd.DataFrame(rows, columns=["size", "rule", "verdict"])
            return frame.astype({"size": "Int32", "rule": object, "verdict": object})

        # Structs compare by size first; null counts as less than any.
        best = F.greatest(best, F.when(longest("host", "path")["size"].isNotNull(), longest("host", "path")))
    return parts.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_best")
