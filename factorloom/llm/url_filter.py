"""Allow and block rules for URLs, held in a trie over reversed host labels and path segments.

The longest rule that fits decides. A rule fits its host and every subdomain of it, for URLs whose
path starts with the rule's path. Length is counted in characters of host and path together; of two
equally long rules the one with the longer host wins. The trie is broadcast if its rules are few
enough; more rules are joined, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import materialize

#: Largest total of rule characters that are broadcast as a trie; more rules are joined.
MAX_TRIE_CHARS = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class Rule:
    """``action`` is allow or block; ``path`` starts with a slash, or is empty for the whole host."""

    action: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class _Segment:
    children: dict[str, _Segment] = field(default_factory=dict)
    #: Rules whose last, perhaps unfinished, segment is looked for here, by its length.
    tails: dict[int, dict[str, Rule]] = field(default_factory=dict)


@dataclass
class _Label:
    children: dict[str, _Label] = field(default_factory=dict)
    paths: _Segment | None = None


class RuleTrie:
    """Host labels from the right, then path segments from the left.

    Neither building nor looking up depends on how many rules share a host or a segment: a segment's
    unfinished rules are found by the prefixes of the lengths that occur there.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = _Label()
        for rule in rules:
            label = self.root
            for name in reversed(rule.host.split(".")):
                label = label.children.setdefault(name, _Label())
            label.paths = label.paths or _Segment()
            *whole, tail = rule.path.split("/")
            segment = label.paths
            for name in whole:
                segment = segment.children.setdefault(name, _Segment())
            segment.tails.setdefault(len(tail), {}).setdefault(tail, rule)

    @staticmethod
    def _deepest(segment: _Segment, parts: list[str]) -> Rule | None:
        best = None
        for name in parts:
            fits = [size for size, tails in segment.tails.items() if size <= len(name) and name[:size] in tails]
            if fits:
                best = segment.tails[max(fits)][name[: max(fits)]]
            if (deeper := segment.children.get(name)) is None:
                return best
            segment = deeper
        return best

    def find(self, host: str, path: str) -> Rule | None:
        label, parts, best = self.root, path.split("/"), None
        for name in reversed(host.split(".")) if host else ():
            if (label := label.children.get(name)) is None:
                break
            if label.paths is not None and (rule := self._deepest(label.paths, parts)) is not None:
                if best is None or len(rule.name) >= len(best.name):
                    best = rule
        return best


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _by_trie(cut: DataFrame, rules: list[Rule]) -> DataFrame:
    trie = cut.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, action string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(host, path) for host, path in zip(hosts, paths, strict=True)]
        return pd.DataFrame([(r and r.name, r and r.action) for r in found], columns=["rule", "action"], dtype=object)

    return cut.withColumn("__fit", judge("__host", "__path"))


def _by_join(cut: DataFrame, rules: DataFrame) -> DataFrame:
    """Each URL meets the rules of its host's suffixes, under the lengths of path that these rules have."""
    numbered = materialize(cut.withColumn("__row", F.monotonically_increasing_id()), "numbered-urls")
    rules = rules.groupBy("host", "path").agg(F.min(F.struct("place", "action")).alias("first")).select("host", "path", "first.action")
    rules = materialize(rules, "url-rules")
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = numbered.where("__host != ''").select("__row", "__path", F.explode(suffixes).alias("host")).join(sizes, "host")
    tried = tried.select("__row", "host", "__path", F.explode("sizes").alias("size")).where("size <= length(__path)")
    fits = tried.withColumn("path", F.left("__path", F.col("size"))).join(rules, ["host", "path"])
    best = F.max_by(F.struct(F.concat("host", "path").alias("rule"), "action"), F.struct(F.length("host") + F.length("path"), F.length("host")))
    return numbered.join(fits.groupBy("__row").agg(best.alias("__fit")), "__row", "left").drop("__row")


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", max_trie_chars: int = MAX_TRIE_CHARS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to every row.

    ``rules`` is a list, or a table of action, host and path. Columns of these names in the input are
    replaced. Null URLs and URLs without ``://`` have empty host and path, fit no rule and get
    ``default``; repeated rows are judged alike; an empty table gives an empty result. Of two rules with
    the same host and path the first of a list counts, of a table the one that allows. Rules of up to
    ``max_trie_chars`` characters are broadcast; more are joined, so no rule is dropped.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(url))
    cut = pages.withColumns({"__host": host, "__path": path}).select(*kept, "__host", "__path")
    if isinstance(rules, DataFrame):
        table = rules.select("action", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host is not null")
        if (table.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0) <= max_trie_chars:
            rules = [Rule(r["action"], r["host"], r["path"]) for r in table.orderBy("action").collect()]
        else:
            rules = table.withColumn("place", F.lit(0).cast("bigint"))
    else:
        rules = [Rule(r.action, r.host.translate(_TO_LOWER), r.path) for r in rules]
    if isinstance(rules, list) and sum(len(r.name) for r in rules) > max_trie_chars:
        rows = [(k, r.action, r.host, r.path) for k, r in enumerate(rules)]
        rules = pages.sparkSession.createDataFrame(rows, "place bigint, action string, host string, path string")
    judged = _by_join(cut, rules) if isinstance(rules, DataFrame) else _by_trie(cut, rules)
    verdict = F.coalesce("__fit.action", F.lit(default))
    return judged.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), "__fit.rule", verdict.alias("verdict"))
