"""The given tables in the roles that the operators ask for: a graph, annotations, assessments, lexicons and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import last_wins

#: (keyword, category = nation, topic-defining). Words that occur in the texts.
LEXICON = (
    ("the", "1", False), ("thon", "2", True), ("tion", "2", False), ("license", "3", True), ("data", "4", True), ("and", "1", False),
    ("ver", "5", False), ("que", "6", False), ("ment", "6", False), ("of the", "7", False), ("version", "3", False), ("keit", "5", True), ("ing", "8", False),
)
#: (pattern, feature, is safeguard)
FEATURES = (
    (r"\btion", "f_tion", False), (r"thon", "f_thon", False), (r"license", "f_license", False), (r"version [0-9]", "s_version", True),
    (r"\bdata\b", "f_data", False), (r"keit|heit", "f_keit", False), (r"\bque\b", "f_que", False), (r"[0-9]{4}", "f_digits", False), (r"!!", "f_loud", False), (r"@", "s_mail", True),
)
#: (rule_id, dimension, priority, severity, any_of, all_of, none_of, compound, message)
RULES = (
    ("r1", "style", 1, "Warning", ["f_loud"], [], [], [], "loud text"), ("r2", "legal", 2, None, ["f_license", "f_data"], [], ["s_version"], [], "terms without a version"),
    ("r3", "language", None, "Info", ["f_keit", "f_que"], [], [], [], "not English"), ("r4", "privacy", 3, "Violation", ["f_digits"], [], [], [], "long numbers"),
    ("c1", "privacy", 4, "Violation", [], ["f_digits", "s_mail"], [], ["privacy", "style"], "numbers with an address"), ("c2", "mixed", 5, None, [], ["f_thon", "f_tion"], ["f_loud"], ["language", "style"], "both stems"),
)
RULE_SCHEMA = "rule_id string, dimension string, priority int, severity string, any_of array<string>, all_of array<string>, none_of array<string>, compound array<string>, message string"


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "keyword string, category string, is_specific boolean")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in RULES], RULE_SCHEMA)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, rater, stratum, run, label, ord, tags, sufficiency): line items of an order as its raters, the last row of a
    repeated key; numbers 1-3 are the runs of stratum 1, 4-6 those of stratum 2."""
    (line,) = read(spark, sf_dir, "lineitem")
    rows = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").where("l_linenumber <= 6")
    rows = last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return rows.select(
        F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater"), F.when(F.col("l_linenumber") <= 3, 1).otherwise(2).alias("stratum"), (F.pmod(F.col("l_linenumber") - 1, F.lit(3)) + 1).alias("run"),
        F.col("l_returnflag").alias("label"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("ord"),
        F.array(F.pmod("l_suppkey", F.lit(18)).cast("int")).alias("tags"), (1 + F.pmod(F.floor("l_quantity"), F.lit(5))).cast("int").alias("sufficiency"),
    )


ANN = """l as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc, l_returnflag desc) as rn from lineitem where l_linenumber <= 6),
ann as (select l_orderkey as item, l_linenumber as rater, case when l_linenumber <= 3 then 1 else 2 end as stratum, (l_linenumber - 1) % 3 + 1 as run, l_returnflag as label,
  case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as ord, (l_suppkey % 18)::int as tag, (1 + floor(l_quantity)::int % 5)::int as sufficiency from l where rn = 1)"""


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, a_tags, b_tags): per order the sets of supplier groups of its odd and of its even lines."""
    (line,) = read(spark, sf_dir, "lineitem")
    tag, odd = F.pmod("l_suppkey", F.lit(18)).cast("int"), F.pmod("l_linenumber", F.lit(2)) == 1
    return line.groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_set(F.when(odd, tag))).alias("a_tags"), F.array_sort(F.collect_set(F.when(~odd, tag))).alias("b_tags"))


SETS = """s as (select l_orderkey as item, coalesce(list_sort(list(distinct (l_suppkey % 18)::int) filter (l_linenumber % 2 = 1)), []) as a, coalesce(list_sort(list(distinct (l_suppkey % 18)::int) filter (l_linenumber % 2 = 0)), []) as b from lineitem group by 1)"""


def assessor_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((assessor, item, label, tags), (item, ref_label, ref_tags)): raters 2 to 6 as assessors, rater 1 as the reference."""
    ann = annotations(spark, sf_dir)
    ref = ann.where("rater = 1").select("item", F.col("label").alias("ref_label"), F.col("tags").alias("ref_tags"))
    return ann.where("rater > 1").select(F.concat(F.lit("m"), F.col("rater").cast("string")).alias("assessor"), "item", "label", "tags"), ref


def kappa_sql(name: str, source: str, by: str, stat: str = "kappa") -> str:
    """CTEs that end in `name` (by, kappa, alpha, raw, kinds) of a source of cells (by, a, b, n)."""
    keys = [k.strip() for k in by.split(",")] if by else []
    sel = "".join(f"{k}, " for k in keys)
    using = f"using ({', '.join(keys)})" if keys else "on true"
    grp = f"group by {', '.join(keys)}" if keys else ""
    return f"""{name}_c as ({source}), {name}_m as (select {sel}x, sum(na)::double as na, sum(nb)::double as nb from (select {sel}a as x, n as na, 0 as nb from {name}_c union all select {sel}b, 0, n from {name}_c) group by {sel}x),
{name}_t as (select {sel}sum(n)::double as t, sum(case when a = b then n else 0 end)::double as s from {name}_c {grp}), {name}_e as (select {sel}sum(na * nb) as e, sum((na + nb) * (na + nb)) as sq, count(*) filter (na > 0) as ka, count(*) filter (nb > 0) as kb from {name}_m {grp}),
{name} as (select {sel}case when e = t * t then 1.0 else (s / t - e / (t * t)) / (1 - e / (t * t)) end as kappa, case when 2 * t <= 1 or 4 * t * t = sq then null else 1 - (1 - s / t) / ((4 * t * t - sq) / (2 * t * (2 * t - 1))) end as alpha, s / t as raw, ka, kb, t from {name}_t join {name}_e {using})"""


def _number(text: str, at: int = 1) -> str:
    return f"('0x' || substr(md5({text}), {at}, 15))::bigint % 2147483647"


def uniform_sql(h: str, a: str, b: str) -> str:
    """The draw of operators/draws.py."""
    x = f"(({h} * {a} + {b}) % 2147483647)"
    y = f"({x} * {x} % 2147483647)"
    return f"({y} * {y} % 2147483647 * {x} % 2147483647 / 2147483647)"


def seeds_sql(seed: str, reps: int) -> str:
    """A select of (rep, ra, rb)."""
    return f"select rep, {_number(f'{seed} || rep')} as ra, {_number(f'{seed} || rep', 16)} as rb from range({reps}) r(rep)"


def poisson_sql(name: str, source: str, seed: int, reps: int, also: str = "") -> str:
    """CTEs that end in `name` (key, also, rep, w): weights of a source of (key, mean, also)."""
    more = f", {also}" if also else ""
    return f"""{name}_k as materialized (select *, {_number('key')} as h from ({source})), {name}_s as materialized ({seeds_sql(f"'{seed}:'", reps)}),
{name}_p as (select mean, lo, unnest(range(lo, ceil(mean + 10 * sqrt(mean) + 10)::bigint + 1)) as k from (select distinct mean, greatest(0, floor(mean - 10 * sqrt(mean) - 10))::bigint as lo from {name}_k)),
{name}_q as (select mean, lo, k, exp(k * ln(mean) - mean - lgamma(k + 1)) as p from {name}_p), {name}_t as materialized (select mean, lo, k, sum(p) over (partition by mean order by k) / sum(p) over (partition by mean) as cdf from {name}_q),
{name}_u as (select key{more}, mean, rep, {uniform_sql('h', 'ra', 'rb')} as u from {name}_k, {name}_s),
{name} as materialized (select key{more.replace(', ', ', u.')}, rep, coalesce(t.k + 1, greatest(0, floor(u.mean - 10 * sqrt(u.mean) - 10))::bigint) as w from {name}_u u asof left join {name}_t t on u.mean = t.mean and u.u >= t.cdf)"""


def binomial_sql(name: str, source: str, p: str) -> str:
    """CTEs that end in `name`: the source (n, u, more) with k, drawn from n at the share p, an expression over the source."""
    return f"""{name}_i as materialized (select *, ({p})::double as p from ({source})), {name}_d as (select distinct n, p, n * p as m, sqrt(n * p * (1 - p)) as d from {name}_i where n > 0 and p > 0 and p < 1),
{name}_r as (select n, p, unnest(range(greatest(0, floor(m - 10 * d - 10))::bigint, least(n, ceil(m + 10 * d + 10)::bigint) + 1)) as k from {name}_d),
{name}_q as (select *, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) as q from {name}_r),
{name}_t as materialized (select n, p, k, sum(q) over (partition by n, p order by k) / sum(q) over (partition by n, p) as cdf from {name}_q),
{name} as materialized (select i.* exclude (p), case when i.n = 0 or i.p <= 0 then 0 when i.p >= 1 then i.n else coalesce(t.k + 1, greatest(0, floor(i.n * i.p - 10 * sqrt(i.n * i.p * (1 - i.p)) - 10))::bigint) end as k from {name}_i i asof left join {name}_t t on i.n = t.n and i.p = t.p and i.u >= t.cdf)"""
