"""Queries over records and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import records as X
from .plans import mirror as M
from .registry import ORACLE, query


@query("""with r as (select event_id, event_type as label, case when user_id % 10 = 0 then null else ['a', event_type] end as tags, case when user_id % 11 = 0 then 'x' else (floor(value) % 7)::int::varchar end as n from events),
c as (select *, try_cast(n as int) as k from r) select event_id, label, list_filter(tags, lambda t: t in ('view', 'click')) as tags, k as n,
case when label not in ('view', 'click', 'purchase') then 'label' when tags is null then 'tags' when k is null then 'number' when k < 1 or k > 5 then 'range' end as error from c""")
def validated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("event_type").alias("label"), F.when(F.pmod("user_id", F.lit(10)) != 0, F.array(F.lit("a"), "event_type")).alias("tags"), F.when(F.pmod("user_id", F.lit(11)) == 0, "x").otherwise(F.pmod(F.floor("value"), F.lit(7)).cast("int").cast("string")).alias("n"))
    return X.validate_record(rows, "label", ["view", "click", "purchase"], "tags", ["view", "click"], "n")


@query("""with v(pos, entry, stem) as (values (1, 'STEEL', 'STEEL'), (2, 'BRASS', 'BRASS'), (3, 'PROMO', 'PROMO'), (4, 'TIN', 'TIN')), t as (select distinct p_type as tag from part)
select tag, (select entry from v where tag = entry or contains(tag, stem) or contains(entry, tag) order by tag <> entry, pos limit 1) as entry from t""")
def mapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = M.read(spark, sf_dir, "part")
    vocab = spark.createDataFrame([(i + 1, x, x) for i, x in enumerate(["STEEL", "BRASS", "PROMO", "TIN"])], "pos int, entry string, stem string")
    return X.fuzzy_vocab(p.select("p_type"), vocab, "p_type")


@query("""select c_custkey, c_name from customer where c_nationkey in (1, 5, 9) and c_mktsegment = 'BUILDING'""")
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = M.read(spark, sf_dir, "customer")
    return X.tab_filter(c, "c_mktsegment", "BUILDING").join(F.broadcast(X.inline_values(spark, "c_nationkey", [1, 5, 9])), "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("""select d.doc_id, coalesce(case when source <> 'src0' then source end, 'default') as source, case when lang = 'en' then [source] else [lang] end as expected, quality, 'all' as kind from documents d left join labels using (doc_id)
union all select d.doc_id, coalesce(case when source <> 'src0' then source end, 'default'), case when lang = 'en' then [source] else [lang] end, quality, 'missing' from documents d left join labels using (doc_id) where quality is null""")
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = M.read(spark, sf_dir, "documents", "labels")
    rows = d.select("doc_id", F.when(F.col("source") != "src0", F.col("source")).alias("source"), F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang")).alias("expected"), F.array("source").alias("twin"))
    filled, missing = X.backfill_defaults(rows, "doc_id", {"source": F.lit("default")}, {"expected": "twin"}, lab.select("doc_id", "quality"), ["quality"])
    keep = lambda df, k: df.select("doc_id", "source", "expected", "quality", F.lit(k).alias("kind"))
    return keep(filled, "all").unionByName(keep(missing, "missing"))


@query("""select event_id, case when event_type in ('High', 'Medium', 'Low') then event_type when contains(lower(event_type), 'low') then 'Low' when value > 80 then 'High' when value > 40 then 'Medium' when value > 10 then 'Low' end as label,
case when event_type = 'view' then 'view' when contains(lower(props || ' ' || event_type), 'click') then 'click' end as category, case when user_id % 3 = 0 then 'v' || (user_id % 5) end as hit from events""")
def fallback_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    sev = F.when(F.col("value") > 80, F.array(F.lit("low"), F.lit("HIGH"))).when(F.col("value") > 40, F.array(F.lit("moderate"))).when(F.col("value") > 10, F.array(F.lit("low"))).otherwise(none)
    reqs = F.array(F.struct(F.pmod("user_id", F.lit(3)).alias("k"), F.concat(F.lit("v"), F.pmod("user_id", F.lit(5)).cast("string")).alias("v")))
    return e.select("event_id", T.label_with_fallback(F.col("event_type"), sev).alias("label"), T.resolve_category(F.when(F.col("event_type") == "view", F.col("event_type")), [F.col("props"), F.col("event_type")], ["view", "click"]).alias("category"), T.first_match(reqs, lambda r: r["k"] == 0)["v"].alias("hit"))


@query(f"with c as ({ORACLE['validated_records']}) select event_id, label, tags, n, coalesce(error, 'none') as error from c")
def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid records and those in quarantine, put together again with their kind."""
    valid, bad = X.split_valid(validated_records(spark, sf_dir))
    return valid.withColumn("error", F.lit("none")).unionByName(bad)


@query("select doc_id, quality, 'known' as kind from documents join labels using (doc_id)")
def complete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is known; none of them may lack a required field."""
    d, lab = M.read(spark, sf_dir, "documents", "labels")
    filled, missing = X.backfill_defaults(d.select("doc_id", F.lit(None).cast("string").alias("kind")).join(lab.select("doc_id"), "doc_id"), "doc_id", {"kind": F.lit("known")}, {}, lab.select("doc_id", "quality"), ["quality", "kind"])
    return X.reject_missing(filled, missing).select("doc_id", "quality", "kind")
