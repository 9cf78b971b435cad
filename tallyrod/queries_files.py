"""Queries over files, provenance, priorities and a small rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph as G
from .operators import rules as R
from .plans import mirror as M
from .registry import query
from .sources import tables as X
from .sources.shared import shared_dir


@query(r"""with f as (select doc_id, case doc_id % 3 when 0 then 'P' || doc_id || '_full.json' when 1 then 'run-' || doc_id || '.json' else 'notes' || doc_id || '.txt' end as file from documents)
select doc_id, file, case when regexp_matches(file, '^P([0-9]+)_full') then regexp_extract(file, '^P([0-9]+)_full', 1) else regexp_extract(file, '-([0-9]+)\.json$', 1) end as key, case when regexp_matches(file, '^P([0-9]+)_full') then 0 else 1 end as prio from f where regexp_matches(file, '^P([0-9]+)_full|-([0-9]+)\.json$')""")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    i, n = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(3))
    file = F.when(n == 0, F.concat(F.lit("P"), i, F.lit("_full.json"))).when(n == 1, F.concat(F.lit("run-"), i, F.lit(".json"))).otherwise(F.concat(F.lit("notes"), i, F.lit(".txt")))
    return X.file_key(d.select("doc_id", file.alias("file")), ["^P([0-9]+)_full", r"-([0-9]+)\.json$"])


@query("select source, lang, count(*) as n, sum(n_chars)::bigint as n_chars, case when max(n_chars) > 100 then avg(n_chars) end as mean from documents group by all")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON, in which values that are not finite are null, and read again."""
    (d,) = M.read(spark, sf_dir, "documents")
    mean = F.when(F.max("n_chars") > 100, F.avg("n_chars")).otherwise(F.lit(float("nan"))).alias("mean")
    report = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("n_chars"), mean)
    path = f"{shared_dir(spark)}/report"
    X.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("select l_orderkey as doc, list(l_suppkey order by l_linenumber, l_suppkey) as ids from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey % 3 = 1) group by 1")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = M.read(spark, sf_dir, "lineitem", "supplier")
    own = li.groupBy(F.col("l_orderkey").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("ids"))
    return G.provenance("1", own, s.select(F.col("s_suppkey").alias("id"), F.pmod("s_nationkey", F.lit(3)).cast("string").alias("category")))


@query("select c_nationkey % 5 as priority, 'r' || c_custkey as rule_id, c_name as message from customer order by 1, 2")
def findings_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = M.read(spark, sf_dir, "customer")
    return G.sort_by_priority(c.select(F.pmod("c_nationkey", F.lit(5)).alias("priority"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("rule_id"), F.col("c_name").alias("message")))


@query("select doc_id, case lang when 'en' then 'English' when 'de' then 'German' else coalesce(lang, 'none') end as language from documents")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    names = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    return d.select("doc_id", T.lookup(names, F.coalesce("lang", F.lit("")), F.coalesce("lang", F.lit("none"))).alias("language"))


_MARKS = ("license", "data", "password", "email", "copyright", "version")


@query("with f as (select doc_id as doc, lower(text) as t from documents) " + " union all ".join(
    f"select doc, 'd{i}' as rule_id, '{'legal' if i % 2 == 0 else 'technical'}' as dimension, {i + 1} as priority, 'Violation' as severity, '{m} is named' as message from f where contains(t, '{m}')" + (" and not contains(t, 'license')" if m == "copyright" else "") for i, m in enumerate(_MARKS)))
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of six rules, one a mark; one of them only holds where another mark is missing."""
    (d,) = M.read(spark, sf_dir, "documents")
    features = R.extract_features(d, [(m, m, False) for m in _MARKS])
    table = [(f"d{i}", "legal" if i % 2 == 0 else "technical", i + 1, None, f"{m} is named", [m], [], ["license"] if m == "copyright" else []) for i, m in enumerate(_MARKS)]
    rules = spark.createDataFrame(table, "rule_id string, dimension string, priority int, severity string, message string, any_of array<string>, all_of array<string>, none_of array<string>")
    return R.apply_rules(features, rules)


@query("with n as (select event_type, count(distinct user_id) as n from events group by 1) select event_type, n, (case when 3 * n >= 2 * max(n) over () then 1 when 3 * n >= max(n) over () then 2 else 3 end)::int as priority from n")
def evidence_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "events")
    return R.evidence_priority(e, "event_type", "user_id")


@query("""select n_nationkey as nation, n_name as name, (select list(distinct c_mktsegment order by c_mktsegment) from customer where c_nationkey = n_nationkey) as risks from nation where n_nationkey % 7 <> 3 and n_nationkey in (select c_nationkey from customer)""")
def assessments_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document a nation, of which some failed, written and read again."""
    n, c = M.read(spark, sf_dir, "nation", "customer")
    risks = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("risks"))
    rows = n.join(risks, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    failed = F.when(F.pmod("n_nationkey", F.lit(7)) == 3, F.lit("timed out"))
    rows = rows.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.struct(F.col("risks").alias("identified_risks"), failed.alias("error")).alias("assessment"))
    path = f"{shared_dir(spark)}/assessments"
    rows.select(F.col("nation").alias("file"), F.to_json(F.struct("nation", "name", "assessment")).alias("value")).write.partitionBy("file").text(path)
    schema = "nation int, name string, assessment struct<identified_risks: array<string>, error: string>"
    return X.read_assessments(spark, f"{path}/*", schema, name_glob="*.txt").select("nation", "name", F.col("assessment.identified_risks").alias("risks"))


@query("select doc_id, quality, toxic from labels")
def annotations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as JSON arrays in files, read again, with a least number of them."""
    (lab,) = M.read(spark, sf_dir, "labels")
    rows = lab.groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "quality", "toxic"))).alias("value"))
    path = f"{shared_dir(spark)}/annotations"
    rows.write.partitionBy("part").text(path)
    return X.read_annotations(spark, f"{path}/*", 1, "doc_id long, quality int, toxic int")
