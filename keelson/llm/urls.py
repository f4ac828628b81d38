"""URL allow and block rules: a trie over reversed host labels and path segments, longest match first.

``judge`` takes any table with a url column. A rule is (host, path prefix, verdict). It fits its host and all
subdomains when the url's path starts with the prefix; more host labels win over fewer, then the longer path, and at
a tie of both, block wins. Null urls and urls without ``://`` have an empty host and path, so only a rule of an empty
host could fit; the default verdict stands for them. Extra columns pass through; clashing ones are replaced.

The trie is broadcast only up to MAX_TRIE_RULES rules of MAX_TRIE_CHARS characters together; beyond that, urls are joined
with the rule table on a suffix of their host and a prefix of their path, both by equality. Repeated urls are judged alike,
an empty table stays empty, without rules the default stands for all, and urls of any length are taken whole. Hosts
are lower-cased A-Z only, in urls and rules.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import LOWER, UPPER, lower_ascii, table

Rule = tuple[str, str, str]
MAX_TRIE_RULES, MAX_TRIE_CHARS = 200_000, 16_000_000
#: The contract's rules.
RULES: list[Rule] = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


class Trie:
    """Nodes are dicts: host labels from the right, then path segments; a rule's last segment is kept as a prefix."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {"next": {}, "path": None}
        for host, path, verdict in rules:
            self.add(host.translate(str.maketrans(UPPER, LOWER)), path, verdict)

    def add(self, host: str, path: str, verdict: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node["next"].setdefault(label, {"next": {}, "path": None})
        at = node["path"] = node["path"] or {"next": {}, "ends": {}}
        *full, last = path.split("/")
        for segment in full:
            at = at["next"].setdefault(segment, {"next": {}, "ends": {}})
        held = at["ends"].get(last)
        if held is None or verdict == "block":
            at["ends"][last] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        best, node, segments = None, self.root, None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["path"] is not None:
                segments = segments or path.split("/")
                best = self._find_path(node["path"], segments) or best
        return best

    @staticmethod
    def _find_path(at: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if at["ends"]:
                fits = [p for p in at["ends"] if segment.startswith(p)] if len(at["ends"]) < 8 else [segment[:n] for n in range(len(segment) + 1) if segment[:n] in at["ends"]]
                if fits:
                    best = at["ends"][max(fits, key=len)]
            at = at["next"].get(segment)
            if at is None:
                break
        return best


def with_host_and_path(df: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return df.withColumns({"host": lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)})


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null without one) and verdict."""
    pages = with_host_and_path(pages.drop("rule", "verdict"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("chars")).first()
        if size.n > MAX_TRIE_RULES or size.chars > MAX_TRIE_CHARS:
            return _by_join(pages, rules, default)
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").collect()]
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        hits = [find(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(hits, columns=["rule", "verdict"])

    return pages.withColumn("_hit", look_up("host", "path")).select(*pages.columns, "_hit.rule", "_hit.verdict")


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for any number of rules. A host suffix with rules gives the lengths of their paths, so a distinct host and
    path meets at most one rule for each suffix and length."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(lower_ascii(F.col("host")).alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    r = r.groupBy("_h", "_p").agg(F.max("_v").alias("_v"))
    lengths = r.groupBy("_h").agg(F.collect_set(F.length("_p")).alias("_n"))
    asked = pages.select("host", "path").distinct().withColumn("_h", F.explode(suffixes)).join(lengths, "_h")
    asked = asked.select("host", "path", "_h", F.explode(F.filter("_n", lambda n: n <= F.length("path"))).alias("_n"))
    hit = asked.withColumn("_p", F.substr("path", F.lit(1), F.col("_n"))).join(r, ["_h", "_p"])
    order = F.struct(F.size(F.split("_h", r"\.")), "_n")
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict")), order).alias("_hit"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select(*pages.columns, F.col("_hit.rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
r(h, q, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m as (select page_id, arg_max(h || q, len(h) * 1000 + len(q)) as rule, arg_max(v, len(h) * 1000 + len(q)) as verdict
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m using (page_id)
"""
