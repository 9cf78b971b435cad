"""Not-modified revisit records resolved to the responses that they repeat.

Records are captures of URLs: full responses (status 200 with a body) and revisits (304, no body). A revisit is joined
as of its time to the latest earlier full response of the same canonical URL; its validators (entity tag, compared
weakly, else the date of last modification) are checked against that response, and the headers that a 304 may renew
replace the response's own.

A URL may hold a great share of all records. So its records are cut into periods of time: inside a period the latest
response is carried forward by a window; the last response of each period is carried to later periods in a table of at
most one row a URL and period.

Defined cases: records without URL, host or time match nothing and resolve to nothing; at equal times a response counts
as earlier than a revisit only by a smaller record id; repeated records each resolve; a revisit without validators
cannot be checked; no revisits, or no records, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .url_filter import canonical

#: Header fields that a 304 response may renew (RFC 9110 section 15.4.5), and the date of last modification.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Seconds of a period.
PERIOD = 86_400


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def resolve(records: DataFrame, period: int = PERIOD) -> DataFrame:
    """Of records (record_id long, url, ts long, status int, headers map of lower-case names, digest, n_bytes): one row a
    revisit with canonical, response_id, response_ts, digest and n_bytes of its response, verdict ("resolved",
    "mismatch", "unchecked" or "unmatched") and the merged headers where resolved."""
    own = records.select("record_id", canonical(F.col("url")).alias("canonical"), "ts", "status", "headers", "digest", "n_bytes")
    full = (F.col("status") == 200) & F.col("digest").isNotNull()
    able = own.where(F.col("canonical").isNotNull() & F.col("ts").isNotNull() & (full | (F.col("status") == 304)))
    able = able.withColumns({"period": F.floor(F.col("ts") / period), "full": F.when(full, F.struct("ts", "record_id", "headers", "digest", "n_bytes"))})
    able = saved(able.select("record_id", "canonical", "ts", "status", "headers", "period", "full"), "records")
    order = ("ts", "record_id")
    inside = F.last("full", True).over(W.partitionBy("canonical", "period").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    revisits = able.withColumn("latest", inside).where("status = 304").drop("full", "status")
    # The last response of each period, carried to each later period that has records.
    ends = able.groupBy("canonical", "period").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct(F.col("full.ts"), F.col("full.record_id")))).alias("end"))
    carried = F.last("end", True).over(W.partitionBy("canonical").orderBy("period").rowsBetween(W.unboundedPreceding, -1))
    ends = saved(ends.select("canonical", "period", carried.alias("latest")).where("latest is not null"), "periods")
    done = revisits.where("latest is not null")
    rest = revisits.where("latest is null").drop("latest").join(ends, ["canonical", "period"], "left")
    columns = ["record_id", "canonical", "ts", "headers", "latest"]
    found = done.select(*columns).unionByName(rest.select(*columns))
    # Revisits that can match nothing.
    lost = own.where((F.col("status") == 304) & (F.col("canonical").isNull() | F.col("ts").isNull()))
    found = found.unionByName(lost.select("record_id", "canonical", "ts", "headers", F.lit(None).cast(able.schema["full"].dataType).alias("latest")))
    h, r = (lambda k: F.try_element_at("headers", F.lit(k))), (lambda k: F.try_element_at("latest.headers", F.lit(k)))
    checked = F.when(h("etag").isNotNull(), _tag(h("etag")).eqNullSafe(_tag(r("etag")))).when(h("last-modified").isNotNull(), h("last-modified").eqNullSafe(r("last-modified")))
    verdict = F.when(F.col("latest").isNull(), "unmatched").when(checked.isNull(), "unchecked").when(checked, "resolved").otherwise("mismatch")
    out = found.withColumn("verdict", verdict)
    new = F.map_filter("headers", lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    kept = F.map_filter("latest.headers", lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return out.select(
        "record_id", "canonical", "ts", F.col("latest.record_id").alias("response_id"), F.col("latest.ts").alias("response_ts"),
        F.col("latest.digest").alias("digest"), F.col("latest.n_bytes").alias("n_bytes"), "verdict",
        F.when(F.col("verdict") == "resolved", F.map_concat(kept, new)).alias("merged"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records from the table of pages: each page is fetched once, at a time set by its id, and asked for again
    up to four times. Some answers lack a body (status 404), some later answers are full responses with another tag,
    some revisits carry a stale tag, a date alone or nothing."""
    n = F.pmod(F.col("page_id"), F.lit(5)).cast("int")
    at = F.explode(F.sequence(F.lit(0), n)).alias("k")
    rows = pages.select("page_id", "url", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"), at)
    k, p = F.col("k"), F.col("page_id")
    first, renewed = k == 0, (k == 3) & (F.pmod(p, F.lit(2)) == 0)
    full = (first & (F.pmod(p, F.lit(11)) != 4)) | renewed
    status = F.when(full, 200).when(first, 404).otherwise(304)
    tag = F.concat(F.lit('"'), F.substring("sha", 1, 12), F.when((k == 3) & (F.pmod(p, F.lit(2)) == 0) | (k == 4) & (F.pmod(p, F.lit(2)) == 0), "-2").otherwise(""), F.lit('"'))
    tag = F.when((status == 304) & (F.pmod(p, F.lit(7)) == 3), F.lit('"stale"')).when((status == 304) & (F.pmod(p, F.lit(7)) == 5), F.concat(F.lit("W/"), tag)).otherwise(tag)
    tag = F.when((status == 304) & F.pmod(p, F.lit(13)).isin(6, 7), F.lit(None)).otherwise(tag)
    modified = F.when((status == 304) & (F.pmod(p, F.lit(13)) == 7), F.lit(None)).otherwise(F.concat(F.lit("day "), F.pmod(p, F.lit(1000)).cast("string")))
    ts = F.lit(1_600_000_000).cast("long") + F.pmod(p * 977, F.lit(5_000_000)) + k * 40_000
    size = F.when(status == 304, F.lit("0")).otherwise(F.col("bytes").cast("string"))
    pairs = [("content-type", F.lit("text/html")), ("content-length", size), ("date", ts.cast("string")), ("etag", tag), ("last-modified", modified)]
    headers = F.map_filter(F.map_from_arrays(F.array(*(F.lit(a) for a, _ in pairs)), F.array(*(b for _, b in pairs))), lambda _, v: v.isNotNull())
    return rows.select((p * 8 + k).cast("long").alias("record_id"), "url", ts.alias("ts"), status.cast("int").alias("status"), headers.alias("headers"), F.when(full, F.col("sha")).alias("digest"), F.when(full, F.col("bytes")).alias("n_bytes"))
