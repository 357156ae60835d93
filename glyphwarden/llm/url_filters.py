"""URL filters (operator 7): a sort-merge range join of urls with host/path rules.

Hosts are turned round ("a.example.net" becomes "net.example.a."), so that a host
and all its subdomains are one interval of the sorted keys.  Urls are range
partitioned and sorted on (key, id); a sweep then walks each partition once and
keeps the stack of rule hosts whose intervals hold the current key.

Results in special cases: a null url, or one without "://", has an empty host and
path and fits no rule; null ids are ids like others; repeated rows are judged one by one; an empty table gives
an empty result; an url that fits no rule gets `default`.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """'example.net/en/' -> host example.net, path /en/."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, host.lower(), slash + rest)


def reverse_host(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleIndex:
    """Rule hosts as sorted intervals; the rules of one host stand longest first."""

    def __init__(self, rules: list[Rule]):
        hosts: dict[str, list[Rule]] = {}
        for r in rules:
            hosts.setdefault(reverse_host(r.host), []).append(r)
        self.keys = sorted(hosts)
        self.rules = [sorted(set(hosts[k]), key=lambda r: (-len(r.path), r.verdict != "block")) for k in self.keys]


def sweep(index: RuleIndex):
    """A function from ascending keys to the active rule lists, outermost host first."""
    stack: list[tuple[str, list[Rule]]] = []
    at = 0

    def active(key: str) -> list[tuple[str, list[Rule]]]:
        nonlocal at
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        end = bisect_right(index.keys, key, lo=at)
        while at < end:
            k = index.keys[at]
            if key.startswith(k):
                stack.append((k, index.rules[at]))
            at += 1
        return stack

    return active


def best(active: list[tuple[str, list[Rule]]], path: str) -> Rule | None:
    """The longest fitting rule; of equally long ones that of the longer host, then a block."""
    found = None
    for _, rules in active:
        for r in rules:
            if path.startswith(r.path):
                if found is None or (len(r.text), len(r.host)) >= (len(found.text), len(found.host)):
                    found = r
                break
    return found


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.  The rules come from the caller as a list."""
    id_type = pages.schema[id_col].dataType
    keyed = pages.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    ).withColumn(
        "key",
        F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))),
    )
    # the id in the key lets a host with a third of all rows fall into many partitions
    dealt = keyed.repartitionByRange("key", "path", "id").sortWithinPartitions("key")

    def run(batches):
        index = RuleIndex(rules)
        active = sweep(index)
        last, now = None, []
        for b in batches:
            keys, paths = b.column(3).to_pylist(), b.column(2).to_pylist()
            texts, verdicts = [], []
            for key, path in zip(keys, paths, strict=True):
                if key != last:
                    last, now = key, active(key)
                r = best(now, path) if now else None
                texts.append(r.text if r else None)
                verdicts.append(r.verdict if r else default)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array(verdicts, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return dealt.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, host string, path string, rule string, verdict string")
