"""URL filters: a blocked Bloom filter of the listed canonical URLs lets possible hits through to an exact hash join.

All steps are DataFrame expressions. Defined cases: a null url, or one without "://", has empty host and path, fits no
rule, is not listed and is allowed; repeated rows are each judged; an empty list lists nothing; ties between rules that
fit cannot happen, as two rules of one length that fit the same url are the same rule. Columns that have the name of a
result (host, path, rule, listed, verdict) are replaced; others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, saved

#: Lanes of 64 bits in a block; each URL sets one bit in each lane of its block.
LANES = 4
#: Bits of filter for each listed URL.
BITS = 16
#: The filter is broadcast up to so many blocks (of 8 * LANES + 8 bytes); beyond that Spark joins it by shuffle.
BROADCAST_BLOCKS = 4_000_000

#: The rules (host, path, verdict) of the production query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The production list: pages on hosts with one of these labels, which are listed URL by URL.
LISTED_LABELS = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host/path?query with: no scheme, no default port, no leading "www.", no fragment, no trailing slashes, no tracking
    parameters (utm_*, ref). Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike("^(utm_[^=]*|ref)(=|$)") & (x != "")), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. The rules are a short list: one CASE."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, lane: int) -> Column:
    place = F.pmod(F.xxhash64(url, F.lit(lane + 1)), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(listed: DataFrame, url: str = "url") -> tuple[DataFrame, int]:
    """The filter of the list's distinct URLs as a table (block, lane0 ...), and its number of blocks."""
    n = listed.count()
    blocks = max(1, -(-n * BITS // (64 * LANES)))
    return listed.groupBy(_block(F.col(url), blocks).alias("block")).agg(*(F.bit_or(_bit(F.col(url), k)).alias(f"lane{k}") for k in range(LANES))), blocks


def member(df: DataFrame, url: str, listed: DataFrame, out: str = "listed") -> DataFrame:
    """Adds boolean `out`: whether `url` is in column url of `listed`. Rows that the filter rejects are never shuffled;
    those that pass it are joined with the list by URL."""
    df = df.drop(out)
    listed = saved(listed.select("url").where("url is not null").distinct(), "listed")
    table, blocks = bloom(listed)
    names = {f"lane{k}": f"__lane{k}" for k in range(LANES)}
    table = table.select(F.col("block").alias("__block"), *(F.col(k).alias(v) for k, v in names.items()))
    u = F.col(url)
    hit = F.lit(True)
    for k, v in enumerate(names.values()):
        hit = hit & (F.col(v).bitwiseAND(_bit(u, k)) != 0)
    probed = df.withColumn("__block", _block(u, blocks)).join(F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table, "__block", "left")
    probed = probed.withColumn("__hit", u.isNotNull() & F.coalesce(hit, F.lit(False))).select(*df.columns, "__hit")
    exact = listed.select(F.col("url").alias("__listed"))
    hits = probed.where("__hit").join(exact, u == F.col("__listed"), "left").select(*df.columns, F.col("__listed").isNotNull().alias(out))
    return hits.unionByName(probed.where("not __hit").select(*df.columns, F.lit(False).alias(out)))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, listed and verdict: the rule's, else block if the canonical URL is listed, else allow."""
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("__url", F.col(url)).drop(*(c for c in ("host", "path", "rule", "listed", "verdict", "__canonical") if c != url))
    host, path = host_of(F.col("__url")), path_of(F.col("__url"))
    out = pages.withColumns({"host": host, "path": path, "__canonical": canonical(F.col("__url"))})
    out = member(out, "__canonical", listed).drop("__canonical", "__url")
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))})


def listing(pages: DataFrame, labels: Sequence[str] = LISTED_LABELS, url: str = "url") -> DataFrame:
    """The production list: the canonical URLs (column url) of all pages on a host with a listed label."""
    on = F.arrays_overlap(F.split(host_of(F.col(url)), "\\."), F.array(*map(F.lit, labels)))
    return pages.where(on).select(canonical(F.col(url)).alias("url")).distinct()
