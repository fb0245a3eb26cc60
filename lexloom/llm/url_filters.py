"""URL filters: a range join of urls with nested host and path rules by one sorted sweep.

A host with its labels reversed ("blog.example.com" is "com.example.blog.") makes "this host and
all its subdomains" a prefix, and so an interval of the sorted keys. Urls are split into key ranges,
each rule is copied to the ranges that its interval meets, and within a range one pass over the
sorted rows keeps a stack of the hosts whose interval is still open. A host's paths are intervals of the sorted
paths in turn: a url finds the last path up to its own by bisection and climbs to the paths that enclose it.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())]
)
#: No real key holds a character above this one, so prefix + LAST ends the prefix's interval.
LAST = "\U0010ffff"
#: At most so many sampled keys place the boundaries of the ranges; they only balance the work.
SAMPLE = 4000


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; "" if there is none."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; "" if the url is null or has no "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def parse_rule(verdict: str, rule: str) -> tuple[str, str, str]:
    """("block", "com/en/") is host "com", path "/en/"."""
    host, _, path = rule.partition("/")
    return host, f"/{path}", verdict


class _Host:
    """The rules of a host in the order of their paths, each with the nearest one that its path begins with."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.verdicts, self.parents = key, host, [], [], []

    def add(self, path: str, verdict: str) -> None:
        up = len(self.paths) - 1
        while up >= 0 and not path.startswith(self.paths[up]):
            up = self.parents[up]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.parents.append(up)

    def longest(self, path: str) -> int:
        """The place of the longest path that ``path`` begins with, or -1."""
        at = bisect.bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.parents[at]
        return at


def _sweep(batches):
    """Rows come sorted by range, key, kind (rules first) and path; the stack holds the open hosts."""
    current, stack = None, []
    for rows in batches:
        found = []
        for pid, key, kind, row_id, host, path, verdict in rows.itertuples(index=False, name=None):
            if pid != current:
                current, stack = pid, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(_Host(key, host))
                stack[-1].add(path, verdict)
                continue
            best = None
            for open_ in stack:  # at most one for each label of the host
                at = open_.longest(path)
                if at >= 0 and (best is None or len(open_.host) + len(open_.paths[at]) >= len(best[0])):
                    best = open_.host + open_.paths[at], open_.verdicts[at]
            found.append((row_id, host, path, *(best or (None, None))))
        yield pd.DataFrame(found, columns=["row_id", "host", "path", "rule", "rule_verdict"])


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row for each row of ``urls``: id, host, path, the longest fitting rule (null if none) and the verdict.

    ``rules`` has host, path and verdict, one rule for each host and path; a rule fits its host and
    all subdomains where the url's path starts with the rule's. Null urls and urls without "://"
    have an empty host and path and get ``default``; null ids stay, repeated rows are judged one by
    one; other columns of ``urls`` are left out, whatever their names. Rules with a null host or path
    fit nothing. Empty tables give empty results. A hot host is split over ranges by its paths.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col)
    # Ids are text in the sweep, as pandas rounds large ones beside nulls.
    own = urls.select(F.col(id_col).cast("string").alias("row_id"), url_host(url).alias("host"), url_path(url).alias("path")).select(
        "*", F.concat(host_key(F.col("host")), F.lit("\0"), F.col("path")).alias("key")
    )
    # About SAMPLE sampled keys place the boundaries: the driver gets as many, however long the table.
    sort_key = F.concat("key", F.lit("\0"), F.coalesce("row_id", F.lit("")))
    sample = sorted(r[0] for r in own.sample(min(1.0, SAMPLE / max(1, urls.count())), seed=7).select(sort_key).collect())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    @F.pandas_udf(T.IntegerType())
    def range_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect.bisect_right(cuts, k))

    keyed = rules.where("host IS NOT NULL AND path IS NOT NULL").select("host", "path", "verdict", host_key(F.col("host")).alias("key"))
    spread = keyed.select("*", F.explode(F.sequence(range_of("key"), range_of(F.concat("key", F.lit(LAST))))).alias("pid"))
    rows = own.select(
        range_of(sort_key).alias("pid"), "key", F.lit(1).alias("kind"), "row_id", "host", "path", F.lit(None).cast("string").alias("verdict")
    ).unionByName(spread.select("pid", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("row_id"), "host", "path", "verdict"))
    swept = (
        rows.repartition(ranges, "pid")
        .sortWithinPartitions("pid", "key", "kind", "path")
        .mapInPandas(_sweep, T.StructType([T.StructField(c, T.StringType()) for c in ("row_id", "host", "path", "rule", "rule_verdict")]))
    )
    return swept.select(F.col("row_id").cast(urls.schema[id_col].dataType).alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
QUERY_RULES = [parse_rule(*x) for x in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.createDataFrame(QUERY_RULES, RULES))


OP8_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
f AS (
  SELECT u.*, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""
