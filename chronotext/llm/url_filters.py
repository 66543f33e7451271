"""URL filters: a sort-merge range join of urls with prefix rules.

A host with its labels reversed, each followed by a dot (``net.example.www.``), turns "this host and all its subdomains"
into the interval of keys that begin with the rule's key. Urls and rules are dealt to key ranges (a rule to each range
that its interval touches), sorted, and swept once; the sweep keeps the stack of rules whose interval is open. Rules of
one host nest inside those of its parents, so the stack is as deep as a host has labels.

The range bounds come from a bottom-k sample of the keys; the sample only balances tasks, no row depends on it. A hash
of the row follows the host in the sort key, so that one very common host is cut into many ranges.

Defined results: a null url or one without ``://`` has empty host and path and takes the default verdict; repeated rows
are judged one by one; rules with a null or empty host fit nothing; of equally long rules that fit, the one of the
deeper host wins, then ``block``. Other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, partitions

OUT = "page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, each range's rules before the urls that they may fit. State: the stack of open rules."""
    part, stack = None, []  # stack entries: (key prefix, {path length: {path: (rule, verdict)}})
    for pdf in batches:
        out = []
        for pid, key, is_url, page_id, host, path, rule, verdict in zip(*(pdf[c].tolist() for c in ("pid", "key", "is_url", "page_id", "host", "path", "rule", "verdict")), strict=True):
            if pid != part:
                part, stack = pid, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                paths = stack[-1][1].setdefault(len(path), {})
                if verdict == "block" or path not in paths:
                    paths[path] = (rule, verdict)
                continue
            best = None
            for _, by_length in stack:  # from the shortest host to the longest
                for n, paths in by_length.items():
                    if n <= len(path) and (hit := paths.get(path[:n])) and (best is None or len(hit[0]) >= len(best[0])):
                        best = hit
            out.append((page_id, host, path, *(best or (None, verdict))))
        if out:
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per url: ``page_id, host, path, rule, verdict``. ``rules`` has ``host, path, verdict``."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    salt = F.lpad(F.hex(F.xxhash64("page_id", "path").bitwiseAND((1 << 32) - 1)), 8, "0")
    urls = urls.withColumn("key", F.concat(reversed_key(F.col("host")), F.lit("\0"), salt))
    rules = rules.where("host is not null and host <> ''").select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict")
    ).withColumn("key", reversed_key(F.col("host")))

    n = partitions(spark)
    sample = sorted(r[0] for r in urls.select("key").orderBy(F.xxhash64("key"), "key").limit(16 * n).collect())
    bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(bounds, k)).astype("int32")

    fit = rules.select(
        F.explode(F.sequence(range_of("key"), range_of(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))))).alias("pid"),
        "key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict",
    )
    ask = urls.select(range_of("key").alias("pid"), "key", F.lit(True).alias("is_url"), "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    dealt = ask.unionByName(fit).repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "key", "is_url", "path")
    return dealt.mapInPandas(_sweep, OUT)
