"""URL filters by sorted digest arrays (operator 1).

A digest array holds the 64-bit xxhash of each key, sorted, in a file that is memory-mapped, and the keys themselves
in the same order. A batch of strings is probed by one vectorised binary search; a hit counts only if the stored
string is the probed one, so collisions do no harm.

Rules (host and path) are one small array: a url probes every suffix of its host that has no more labels than a rule's host,
joined to every path prefix whose length some rule has; the longest rule wins (of equal length, the longer host). Urls without a rule are held against
a list of urls, which may be as large as the crawl: it is cut by digest into shards of bounded size, each an array of
its own, and meets the distinct probes of that shard. A url that many pages share is probed once.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is allowed. Repeated rows each give
a row; very long urls cost as much as their length; other columns, whatever their names, don't matter; an empty table
gives an empty one.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bounded

#: Keys and probes of one shard, about.
SHARD_ROWS = 100_000
#: The rules of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def digests(strings: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings], np.uint64)


class DigestArray:
    """Sorted digests of distinct keys in a memory-mapped file, with the keys to confirm hits."""

    def __init__(self, keys: Iterable[str], folder: str):
        distinct = list(dict.fromkeys(keys))
        raw = digests(distinct)
        order = np.argsort(raw, kind="stable")
        self.keys = [distinct[i] for i in order]
        path = os.path.join(folder, "digests.npy")
        np.save(path, raw[order])
        self.digests = np.load(path, mmap_mode="r" if len(raw) else None)

    def probe(self, strings: list[str]) -> np.ndarray:
        """Place of each string among the sorted keys, -1 if it is not a key."""
        sought = digests(strings)
        at, found = np.searchsorted(self.digests, sought), np.full(len(strings), -1, np.int64)
        hits = np.flatnonzero(at < len(self.digests))
        for i in hits[self.digests[at[hits]] == sought[hits]]:
            j = at[i]
            while j < len(self.keys) and self.digests[j] == sought[i]:
                if self.keys[j] == strings[i]:
                    found[i] = j
                    break
                j += 1
        return found


class RuleArray:
    """Longest-match lookup of (host, path) among rules, by digest array."""

    def __init__(self, rules: list[tuple[str, str]], folder: str):
        self.verdicts = dict(rules)
        self.lengths = sorted({len(rule) - rule.index("/") for rule, _ in rules})
        self.labels = max((rule.partition("/")[0].count(".") + 1 for rule, _ in rules), default=0)
        self.array = DigestArray(self.verdicts, folder)

    def match(self, hosts: list[str], paths: list[str]) -> list[str | None]:
        tries: list[str] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            # Suffixes of no more labels than some rule's host has, the longest first.
            labels = host.rsplit(".", self.labels)[-self.labels :] if host and self.labels else []
            for a in range(len(labels)):
                suffix = ".".join(labels[a:])
                for n in self.lengths:
                    if n <= len(path):
                        tries.append(suffix + path[:n])
                        owner.append(i)
        best: list[str | None] = [None] * len(hosts)
        for i, t, j in zip(owner, tries, self.array.probe(tries), strict=True):
            # Longer hosts come first, so of equal length the first stays.
            if j >= 0 and (best[i] is None or len(t) > len(best[i])):
                best[i] = t
        return best


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path, and ``bare``: the url up to its query or fragment, if it has one of them."""
    url, pattern = F.coalesce("url", F.lit("")), r"://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = F.contains(url, F.lit("://"))
    bare = F.when(whole & url.rlike("[?#]"), F.regexp_extract(url, r"^([^?#]*)", 1))
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"), bare.alias("bare"))


def with_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            lookup = RuleArray(rules, folder)
            for batch in batches:
                found = lookup.match(batch.column("host").to_pylist(), batch.column("path").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array([lookup.verdicts.get(r) for r in found], pa.string())], names=[*batch.schema.names, "rule", "ruled"])

    return bounded(urls).mapInArrow(run, "page_id long, host string, path string, bare string, rule string, ruled string")


def on_list(probes: DataFrame, listed: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """The distinct non-null values of ``probes.url`` that ``listed.url`` holds."""
    left, right = (df.where(F.col("url").isNotNull()).select(F.concat("url", F.lit("")).alias(name)).distinct() for df, name in ((probes, "url"), (listed, "key")))
    shards = max(1, (right.count() + rows - 1) // rows)
    left, right = (df.withColumn("shard", F.pmod(F.xxhash64(name), F.lit(shards))) for df, name in ((left, "url"), (right, "key")))

    def probe(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"url": pd.Series(dtype=str)})
        with tempfile.TemporaryDirectory() as folder:
            return a[["url"]][DigestArray(b["key"], folder).probe(a["url"].tolist()) >= 0]

    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(probe, "url string")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict. Without a rule, a url is blocked if it has a query or fragment and ``listed``
    (column ``url``) holds what stands before that: it is a variant of a page on the list. All others are allowed."""
    judged = with_rules(parsed(pages), rules)
    hits = on_list(judged.where(F.col("rule").isNull()).select(F.col("bare").alias("url")), listed).select(F.col("url").alias("bare"), F.lit("block").alias("variant"))
    verdict = lambda variant: F.coalesce("ruled", F.when(F.col("rule").isNull(), variant), F.lit("allow")).alias("verdict")
    # Urls that can't be on the list are most of them; they don't meet it.
    may = F.col("rule").isNull() & F.col("bare").isNotNull()
    met = judged.where(may).join(hits, "bare", "left").select("page_id", "host", "path", "rule", verdict(F.col("variant")))
    return judged.where(~may).select("page_id", "host", "path", "rule", verdict(F.lit(None))).unionByName(met)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES, pages.where(~F.col("url").rlike("[?#]")).select("url"))


_RULES_SQL = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in RULES)
ORACLE = f"""
WITH rules(rule, rhost, rpath, rverdict) AS (VALUES {_RULES_SQL}),
urls AS (
    SELECT page_id, coalesce(url, '') AS url,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
),
best AS (
    SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS rverdict
    FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY page_id, url
)
SELECT u.page_id, u.host, u.path, b.rule,
    coalesce(b.rverdict, CASE WHEN contains(u.url, '://') AND regexp_matches(u.url, '[?#]')
        AND regexp_extract(u.url, '^([^?#]*)', 1) IN (SELECT url FROM pages WHERE url IS NOT NULL AND NOT regexp_matches(url, '[?#]')) THEN 'block' END, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON u.page_id IS NOT DISTINCT FROM b.page_id AND u.url = b.url
"""
