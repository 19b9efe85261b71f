"""Allow and block rules for urls, by a sort-merge range join.

A host is written with its labels reversed, each followed by a full stop: ``www.example.net`` becomes
``net.example.www.``. The hosts that a rule covers (its own and all subdomains) are then exactly the keys with
the rule's key as a prefix, which is one interval of the sort order: from ``net.example.`` up to ``net.example/``,
as ``/`` follows ``.`` and no host holds it. Intervals of rules are nested or apart. So one sweep over urls and
rules in key order, with the rules whose interval is open on a stack, finds all that cover a url.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceshift.llm.common import tasks

#: Rows looked at to choose where key ranges are cut. Only the balance depends on it.
CUT_SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (part, key, rules first). Only open rules are held, one entry for each nested host."""
    part, stack = None, []  # entries: end of the interval, host, {length of path: {path: verdict}}, from long to short
    for batch in batches:
        found_rule, found_verdict = [], []
        columns = (batch[c] for c in ("part", "key", "is_rule", "host", "path", "verdict"))
        for at, key, is_rule, host, path, verdict in zip(*columns, strict=True):
            if at != part:
                part, stack = at, []
            while stack and key >= stack[-1][0]:
                stack.pop()
            rule, said = None, None
            if is_rule:
                if not stack or stack[-1][1] != host:
                    stack.append((key[:-1] + "/", host, {}))
                same = stack[-1][2].setdefault(len(path), {})
                same[path] = max(verdict, same.get(path, ""))  # the same rule twice: block goes before allow
            else:
                for _, rule_host, paths in reversed(stack):
                    for n in sorted(paths, reverse=True):
                        if n <= len(path) and path[:n] in paths[n]:
                            rule, said = rule_host + path[:n], paths[n][path[:n]]
                            break
                    if rule is not None:
                        break
            found_rule.append(rule)
            found_verdict.append(said)
        out = pd.DataFrame({"id": batch["id"], "host": batch["host"], "path": batch["path"], "rule": pd.Series(found_rule, dtype=object, index=batch.index), "verdict": pd.Series(found_verdict, dtype=object, index=batch.index)})
        yield out[~batch["is_rule"]]


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row for each row of urls (id, url): id, host, path, rule, verdict.

    rules: (host, path, verdict). A rule covers its host and all subdomains where the url's path starts with its
    path; the longest host wins, then the longest path; of the same rule with both verdicts, block. Urls without a rule get
    default and a null rule. Null and malformed urls have an empty host and path; no rule with a host covers them.

    The key space is cut where a sample has its quantiles. Urls of one key that spans several cuts are spread
    over all of those parts by a hash, so a host with a third of the rows is shared out. A rule goes to each part
    that its interval meets, so wide rules are repeated by the number of parts, never by rows.
    """
    spark = urls.sparkSession
    n = tasks(spark) * 4
    pages = urls.select(F.col("id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pages = pages.withColumn("key", host_key(F.col("host")))
    every = max(1, pages.count() // CUT_SAMPLE)
    sample = pages.where(F.pmod(F.xxhash64("id", "key"), F.lit(every)) == 0).select("key").limit(2 * CUT_SAMPLE)
    sample = sample.toPandas()["key"].sort_values(ignore_index=True)
    cuts = [sample[i * len(sample) // n] for i in range(1, n)] if len(sample) else []

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Part i holds keys from cut i - 1 (included) up to cut i. A key that is itself several cuts may go to any of the parts between."""
        for batch in batches:
            low = [bisect.bisect_left(cuts, k) for k in batch["key"]]
            high = [bisect.bisect_right(cuts, k) for k in batch["key"]]
            spread = [b if b - a < 2 else a + 1 + h % (b - a) for a, b, h in zip(low, high, batch["salt"], strict=True)]
            yield batch.drop(columns="salt").assign(part=spread)

    def place_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # The first part that may hold the key itself, to the last that starts before the interval ends.
            low = [min(bisect.bisect_left(cuts, k) + 1, bisect.bisect_right(cuts, k)) for k in batch["key"]]
            high = [bisect.bisect_left(cuts, k[:-1] + "/") for k in batch["key"]]
            yield batch.assign(part=[list(range(a, b + 1)) for a, b in zip(low, high, strict=True)]).explode("part").astype({"part": "int64"})

    id_type = pages.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, host string, path string, key string, is_rule boolean, verdict string, part long"
    left = pages.select("id", "host", "path", "key", F.lit(False).alias("is_rule"), F.lit(None).cast("string").alias("verdict"), F.pmod(F.xxhash64("id", "path"), F.lit(1 << 30)).alias("salt"))
    right = rules.select(F.lit(None).cast(id_type).alias("id"), F.lower("host").alias("host"), "path", F.lit(True).alias("is_rule"), "verdict")
    right = right.select("id", "host", "path", host_key(F.col("host")).alias("key"), "is_rule", "verdict")
    both = left.mapInPandas(place, schema).unionByName(right.mapInPandas(place_rules, schema))
    both = both.repartition(tasks(spark), "part").sortWithinPartitions("part", "key", F.desc("is_rule"))
    judged = both.mapInPandas(sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: The rules of the query: fixed values.
QUERY_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url")
    rules = spark.createDataFrame(QUERY_RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).withColumnRenamed("id", "page_id")


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
