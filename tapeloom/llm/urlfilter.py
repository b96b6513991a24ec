"""URL verdicts from a trie over reversed host labels and path segments.

Rules are (action, host, path). A rule fits its host and all subdomains if the url's path starts with
the rule's path. The fitting rule with most host labels wins, then the longest path; if allow and
block state the same host and path, block wins. A url that no rule fits gets ``default``.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
path is the rest up to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty and fits no
rule with a host. The trie is broadcast, so the number of rules is checked against ``max_rules``;
columns named host, path, rule or verdict are replaced, all others stay, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.batches import unused

MAX_RULES = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


class _Node:
    __slots__ = ("_lengths", "ends", "next")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.ends: dict = {}
        self._lengths: list[int] | None = None

    def lengths(self) -> list[int]:
        """Lengths of the starts that end here, longest first: each is one look-up, however many starts there are."""
        if self._lengths is None:
            self._lengths = sorted({len(s) for s in self.ends}, reverse=True)
        return self._lengths


class RuleTrie:
    """Hosts: one level per label, from the right. Paths, below a host's node: one level per whole segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"a rule's action is {action!r}; allow and block are known")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.next.setdefault(label, _Node())
            at = node.ends.setdefault("", _Node())
            *whole, start = path.split("/")
            for segment in whole:
                at = at.next.setdefault(segment, _Node())
            if at.ends.get(start, ("", "allow"))[1] == "allow":
                at.ends[start] = (host + path, action)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule's text and action."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.ends:
                found = self._path(node.ends[""], path) or found
        return found

    @staticmethod
    def _path(node: _Node, path: str) -> tuple[str, str] | None:
        found, parts = None, path.split("/")
        for i, part in enumerate(parts):
            for n in node.lengths():
                if n <= len(part) and part[:n] in node.ends:
                    found = node.ends[part[:n]]
                    break
            node = node.next.get(part) if i + 1 < len(parts) else None
            if node is None:
                break
        return found


def collect_rules(rules: DataFrame, max_rules: int = MAX_RULES) -> list[Rule]:
    """Rules from a table with columns action, host, path; more than ``max_rules`` raise an error."""
    rows = rules.select("action", "host", "path").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules: too many to broadcast")
    return [tuple(r) for r in rows]


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    rest = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return urls.withColumns({"host": host, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Add host, path, rule (host and path of the rule that decides, else null) and verdict."""
    if len(rules) > max_rules:
        raise ValueError(f"more than {max_rules} rules: too many to broadcast")
    trie = urls.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in parts:
            found = [find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    split = split_url(urls, url)
    name = unused("found", split.columns)
    found = split.withColumn(name, look_up("host", "path"))
    return found.withColumns({"rule": F.col(name)["rule"], "verdict": F.col(name)["verdict"]}).drop(name)
