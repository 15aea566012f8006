"""URL filters: a trie over reversed host labels and then path segments, where the longest matching entry decides.

A rule is (host, path, verdict). It fits a url if the url's host is the rule's or a subdomain of it, and the url's path
starts with the rule's, character for character. Of fitting rules the one with the longest host wins, of these the one
with the longest path; entries that are both allowed and blocked block.

The trie is broadcast after a check of its size. Rule lists beyond the bound are joined instead, by the same steps of
labels and segments as keys, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salt

#: Entries and characters of a trie that is broadcast, at most: some 100 MB in each worker.
MOST_RULES, MOST_CHARS = 250_000, 16 << 20

RULES = "host string, path string, verdict string"
#: Small letters for A-Z and nothing else, as hosts are compared.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_rule(text: str, verdict: str) -> tuple[str, str, str]:
    """(host, path, verdict) of a rule like ``example.net/en/``."""
    host, slash, rest = text.partition("/")
    return host, slash + rest, verdict


def host_of(url: Column) -> Column:
    """What is behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, with small letters for A-Z; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What is behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Numbered nodes with steps between them: (node, label) for host labels from the right, (node, segment) for path
    segments that end in a slash. A node lists its entries as (rest, rule, verdict): a rest is the part of a rule's path
    behind its last slash, the longest first; the url's next characters must begin with it."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.hosts: dict[tuple[int, str], int] = {}
        self.paths: dict[tuple[int, str], int] = {}
        self.entries: dict[int, list[tuple[str, str, str]]] = {}
        n = 0
        for host, path, verdict in sorted(set(rules), key=lambda r: r[2] != "block"):  # a blocking twin comes first
            at = 0
            for label in reversed(host.split(".")):
                n += (new := (at, label) not in self.hosts)
                at = self.hosts.setdefault((at, label), n) if new else self.hosts[at, label]
            *segments, rest = path.split("/")
            for segment in segments:
                n += (new := (at, segment) not in self.paths)
                at = self.paths.setdefault((at, segment), n) if new else self.paths[at, segment]
            here = self.entries.setdefault(at, [])
            if not any(r == rest for r, _, _ in here):
                here.append((rest, host + path, verdict))
        for here in self.entries.values():
            here.sort(key=lambda e: -len(e[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        at, chain = 0, []
        for label in reversed(host.split(".")):
            at = self.hosts.get((at, label))
            if at is None:
                break
            chain.append(at)
        segments = path.split("/")
        for at in reversed(chain):  # the longest host first
            found, begin = None, 0
            for segment in [*segments[:-1], None]:
                for rest, rule, verdict in self.entries.get(at, ()):
                    if path.startswith(rest, begin):
                        found = rule, verdict
                        break
                at = None if segment is None else self.paths.get((at, segment))
                if at is None:
                    break
                begin += len(segment) + 1
            if found:
                return found
        return None


def clean_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with small letters in hosts; a null path is an empty one. Rules without a host or with another
    verdict than allow or block are an error."""
    out = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    odd = out.where("host IS NULL OR host = '' OR verdict IS NULL OR verdict NOT IN ('allow', 'block') OR (path <> '' AND NOT startswith(path, '/'))")
    if bad := odd.head(3):
        raise ValueError(f"rules need a host, a path that is empty or begins with a slash, and a verdict of allow or block: {bad}")
    return out


def by_trie(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls with ``_rule`` and ``_verdict`` by the broadcast trie; only hosts and paths go to Python."""
    trie = urls.sparkSession.sparkContext.broadcast(Trie((r["host"], r["path"], r["verdict"]) for r in rules.toLocalIterator()))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        found = [find(h, p) or (None, None) for h, p in zip(hosts, paths)]
        return pd.DataFrame(np.array(found, dtype=object).reshape(-1, 2), columns=["rule", "verdict"])

    return urls.withColumn("_found", judge("_host", "_path")).withColumns({"_rule": F.col("_found.rule"), "_verdict": F.col("_found.verdict")}).drop("_found")


def by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins, for rule lists of any size: each distinct (host, path) meets the rules at all its label
    suffixes and segment prefixes, and the rows get their rule by (host, path, salt)."""
    cut = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    keyed = rules.select(F.col("host").alias("_h"), cut.alias("_p"), F.substr("path", F.length(cut) + 1).alias("_rest"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"))
    salted = urls.withColumn("_salt", salt(*[F.col("_row")[f.name] for f in urls.schema["_row"].dataType if not re.search("map<|variant", f.dataType.simpleString())]))
    place = salted.groupBy("_host", "_path", "_salt").agg(F.lit(1).alias("_one")).groupBy("_host", "_path").agg(F.collect_list("_salt").alias("_salts"))  # 64 salts at most
    most = keyed.agg(F.max(F.size(F.split("_h", r"\."))).alias("h"), F.max(F.size(F.split("_p", "/"))).alias("p")).first()  # none is longer
    labels, parts = F.split("_host", r"\."), F.split("_path", "/", (most["p"] or 1) + 1)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most["h"] or 1) + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.lit((most["p"] or 1) - 1), F.size(parts) - 1)), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    steps = place.select("_host", "_path", prefixes.alias("_ps"), F.explode(suffixes).alias("_h")).withColumn("_p", F.explode("_ps")).drop("_ps")
    met = steps.join(keyed, ["_h", "_p"]).where(F.startswith(F.substr("_path", F.length("_p") + 1), F.col("_rest")))
    order = F.struct(F.length("_h"), F.length("_p") + F.length("_rest"), (F.col("_verdict") == "block").cast("int"))
    best = met.groupBy("_host", "_path").agg(F.max_by(F.struct("_rule", "_verdict"), order).alias("_best"))
    back = place.join(best, ["_host", "_path"]).select("_host", "_path", F.explode("_salts").alias("_salt"), "_best._rule", "_best._verdict")
    return salted.join(back, ["_host", "_path", "_salt"], "left").drop("_salt")


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", keep: list[str] | None = None, most_rules: int = MOST_RULES, most_chars: int = MOST_CHARS) -> DataFrame:
    """The columns ``keep`` of df (all by default) with host, path, rule and verdict of each row's url.

    Null urls and those without ``://`` have an empty host and path, no rule and the verdict ``otherwise``, as have urls
    that no rule fits. Ports and user names are part of a host, as written. Repeated rows and ties are judged one by one,
    alike; empty tables give no rows; long urls are read whole. Columns of df that are called host, path, rule or verdict
    give way to the new ones.
    """
    names = [c for c in (keep or df.columns) if c not in ("host", "path", "rule", "verdict")]
    rules = clean_rules(rules)
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("chars")).first()
    urls = df.select(F.struct(*names, F.lit(0).alias("_")).alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    found = (by_trie if size["n"] <= most_rules and size["chars"] <= most_chars else by_join)(urls, rules)
    return found.select(*[F.col("_row")[n].alias(n) for n in names], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(otherwise)).alias("verdict"))
