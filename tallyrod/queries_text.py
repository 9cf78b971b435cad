"""Queries over texts, ids, the graph and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph as G
from .operators import lexicon as L
from .operators import postings as P
from .operators import reports as D
from .operators import rules as R
from .operators import similarity as S
from .operators.passages import find_passages
from .plans import mirror as M
from .plans.retrieval import retrieve as retrieve_plan
from .plans.retrieval import retrieve_all as retrieve_all_plan
from .registry import ORACLE, query
from .sources import tables as X
from .sources.shared import saved

KEYS = [k for k, _, _ in M.LEXICON]

# Pieces of SQL


def _count_sql(k: str) -> str:
    if " " in k or len(k) > 5:
        return f"((length(lower(text)) - length(replace(lower(text), '{k}', ''))) / {len(k)})::bigint"
    return rf"len(regexp_extract_all(lower(text), '(?:^|[^\p{{L}}\p{{N}}_]){k}'))"


_WORDS = r"greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 1)"
_COUNTS = f"cnt as (select doc_id as doc, unnest([{', '.join(f'{{k: {k!r}, n: {_count_sql(k)}}}' for k in KEYS)}]) as x, {_WORDS} as words from documents), kc as (select doc, x.k as keyword, x.n::bigint as n, words from cnt where x.n > 0)"
_LEX = "lex(keyword, category, spec) as (values " + ", ".join(f"('{k}', '{c}', {str(s).lower()})" for k, c, s in M.LEXICON) + ")"
_SCORES = f"""{_COUNTS}, {_LEX},
sc as (select doc, category, count(distinct keyword) as n_types, sum(n)::bigint as n_occ, bool_or(spec) as specific, 100.0::double * sum(n) / max(words) as density, count(distinct keyword) + 100.0::double * sum(n) / max(words) as score from kc join lex using (keyword) group by all),
gate as (select * from sc where score >= 1.15 and (n_types >= 2 or n_occ >= 2 or specific)),
top as (select doc, category from gate qualify row_number() over (partition by doc order by score desc, category) <= 8)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = M.read(spark, sf_dir, "documents")
    return L.category_scores(L.keyword_counts(docs, KEYS), M.lexicon(spark))


# Functions


@query(r"""select doc_id, lower(trim(lang)) as low, (length(text) - length(replace(text, 'the', ''))) // 3 as parts, """ + _WORDS + r"""::int as words, regexp_extract_all(lower(left(text, 200)), '[a-z]+') as toks,
regexp_matches(text, '(?i)license|version') as any_hit, regexp_replace(left(text, 60), '[^A-Za-z0-9_\-.:]', '_', 'g') as iri, length(trim(text)) >= 50 as long_enough, contains(lower(text), 'license') as has_term,
case when length(text) > 80 then rtrim(left(text, 80), ' ') || '...' else text end as cut, list_filter(list_transform(string_split(left(text, 120), ','), lambda x: trim(x, ' ')), lambda x: x <> '') as csv,
case when length(text) > 5000 then 'High' when length(text) > 1000 then 'Medium' else 'Low' end as band from documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select(
        "doc_id", F.lower(F.trim("lang")).alias("low"), T.substring_count(t, "the").alias("parts"), T.word_count(t).alias("words"), T.tokens(F.left(t, F.lit(200))).alias("toks"), T.any_of(t, ["license", "version"], True).alias("any_hit"),
        T.iri_safe(F.left(t, F.lit(60))).alias("iri"), T.min_length(t).alias("long_enough"), T.contains_ci(t, "license").alias("has_term"), T.truncate_text(t, F.lit(80)).alias("cut"), T.csv_split(T.prefix(t, 120)).alias("csv"),
        T.case_by_thresholds(F.length(t), ((5001, "High"), (1001, "Medium")), "Low").alias("band"),
    )


@query(r"""select page_id, split_part(split_part(url, '/', -1), '#', -1) as local, nullif(regexp_extract(url, '/[a-z]{2}/(\d+)', 1), '') as number, case when starts_with(url, 'https://m.') then 'mobile' when starts_with(url, 'https://') then 'secure' when starts_with(url, 'http://') then 'plain' else 'other' end as bucket,
list_sort(list_distinct(regexp_extract_all(html, 'href="/([^"]+)"', 1))) as ids from pages where starts_with(url, 'http') and contains(url, 'example')""")
def id_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = M.read(spark, sf_dir, "pages")
    u = F.col("url")
    return T.id_filter(p, "url", "http", "example").select(
        "page_id", T.local_name(u).alias("local"), T.article_no(u, pattern=r"/[a-z]{2}/(\d+)").alias("number"), T.bucket_by_prefix(u, [("https://m.", "mobile"), ("https://", "secure"), ("http://", "plain")], "other").alias("bucket"),
        F.array_sort(X.ids_from_text(F.lit(None).cast("array<string>"), F.col("html"), 'href="/([^"]+)"')).alias("ids"),
    )


@query("""select o_orderkey, case when substr(o_orderpriority, 3) in ('HIGH', 'MEDIUM', 'LOW', 'URGENT') then substr(o_orderpriority, 3, 1) || lower(substr(o_orderpriority, 4)) end as label,
case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 end as ord, case when o_totalprice < 50000 or o_custkey < 50 then 'LOW' else 'NORMAL' end as flag, round_even(o_totalprice, 1) as rounded, greatest(0.0, least(1.0, o_totalprice / 100000)) as clamped from orders""")
def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = M.read(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", T.norm_label(F.expr("substring(o_orderpriority, 3)"), ["High", "Medium", "Low", "Urgent"], {"Med": "Medium"}).alias("label"), T.ordinal(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"], 1).alias("ord"),
        T.confidence_flag(F.col("o_totalprice"), F.col("o_custkey"), 50000, 50).alias("flag"), T.round_half_even(F.col("o_totalprice"), 1).alias("rounded"), T.clamp(F.col("o_totalprice") / 100000, 0.0, 1.0).alias("clamped"),
    )


@query(r"""select p_partkey, 'B' || regexp_extract(p_brand, '#(.*)', 1) as strict, regexp_extract(p_brand, '#(.*)', 1) as loose, upper(p_brand) in ('BRAND#12', 'BRAND#13') as listed, p_name is not null and length(p_name) > 0 as named,
(case when p_size > 25 then 2 else 0 end + case when contains(lower(p_type), 'steel') then 3 else 0 end)::int as score, list_filter([case when p_size > 25 then 'large' end, case when contains(lower(p_type), 'steel') then 'steel' end], lambda x: x is not null) as reasons,
case when p_size + 0.5 >= 40 then 'almost perfect' when p_size >= 0.8 then 'almost perfect' else 'slight or none' end as kband, case when contains(lower(p_type), 'brass') then 'BR' when contains(lower(p_type), 'tin') then 'TN' end as term from part""")
def part_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = M.read(spark, sf_dir, "part")
    score, why = T.additive_score([(F.col("p_size") > 25, 2, "large"), (T.contains_ci(F.col("p_type"), "steel"), 3, "steel")])
    return p.select(
        "p_partkey", T.norm_id(F.col("p_brand"), "Brand#", "B").alias("strict"), T.norm_id(F.col("p_brand"), "Brand#", strict=False).alias("loose"), T.in_set(F.upper("p_brand"), ["BRAND#12", "BRAND#13"]).alias("listed"), T.non_empty(F.col("p_name")).alias("named"),
        score.alias("score"), why.alias("reasons"), T.kappa_band(F.col("p_size").cast("double")).alias("kband"), T.resolve_term(F.col("p_name"), F.lit(""), [("zz-none", "none")], []).alias("_x"), T.resolve_term(F.lit("-"), F.col("p_type"), [("QQ", "qqq")], [("brass", "BR"), ("tin", "TN")]).alias("term"),
    ).drop("_x")


@query(r"""select event_id, coalesce(try_cast(regexp_extract(props, '"k"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1) as double), 0.5) as k_raw, least(1.0, greatest(0.0, coalesce(try_cast(regexp_extract(props, '"k"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1) as double), 0.5))) as score,
json_extract_string(props, '$.k')::bigint as k, case when lower(event_type) = 'click' then 'High' when contains(lower(event_type), 'view') then 'Medium' else 'Low' end as label, value >= 3 and value <= 5 as valid from events""")
def event_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "events")
    noisy = F.concat(F.lit("Here it is: ```json\n"), F.col("props"), F.lit("\n``` done"))
    return e.select(
        "event_id", F.coalesce(F.regexp_extract("props", r'"k"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1).try_cast("double"), F.lit(0.5)).alias("k_raw"), T.score_in(F.col("props"), "k").alias("score"), T.json_object(noisy, "k bigint")["k"].alias("k"),
        L.keyword_band(F.col("event_type"), ["^click$"], ["view"]).alias("label"), ((F.col("value") >= 3) & (F.col("value") <= 5)).alias("valid"),
    )


_EDGE = r"[^\p{L}\p{N}_]"


@query(rf"""with a as (select doc_id, text, lower(text) as low, strpos(lower(text), 'version') as p0 from documents)
select doc_id, regexp_replace(left(text, 80), '([a-z])([A-Z])', '\1 \2', 'g') as split, not (p0 > 0 and regexp_matches(substr(low, greatest(p0 - 40, 1), p0 - greatest(p0 - 40, 1)), '(?:^|{_EDGE})(?:not|no|nicht)(?:$|[^\p{{L}}\p{{N}}_.;!?][^.;!?]*$)')) as guard,
regexp_matches(text, '(?:^|[^n]|(?:^|[^u])n)tion') as behind, true as stamped from a""")
def guarded_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-behind and negation windows; the other engine's patterns say the same without looking behind."""
    (d,) = M.read(spark, sf_dir, "documents")
    return d.select("doc_id", T.camel_split(F.left("text", F.lit(80))).alias("split"), R.negation_guard(F.lower("text"), "version", ["not", "no", "nicht"]).alias("guard"), F.col("text").rlike("(?<!un)tion").alias("behind"), T.now_iso().isNotNull().alias("stamped"))


# Sources and sinks


@query(r"""select doc_id as doc, (i - 1)::int as pos, last_value(case when starts_with(line, 'The') then substr(line, 4) end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row) as section, line
from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    return X.scan_sections(d, "doc_id", "text", "The")


@query("""select doc_id, lang, source from documents where source = 'src0' union all select doc_id, 'x' || lang, source from documents where lang = 'en' and source <> 'src0'
union all select doc_id, lang, source from documents where source <> 'src0' and lang <> 'en'""")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    d = d.select("doc_id", "lang", "source")
    return X.overlay_sources([d.where("source = 'src0'"), d.where("lang = 'en'").withColumn("lang", F.concat(F.lit("x"), "lang")), d], ["doc_id"])


@query("""select event_id as item, 'k' as rater, json_extract_string(props, '$.k')::double as rating from events""")
def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "events")
    return X.explode_ratings(e, "event_id", "props", "double")


@query("""with b as (select doc_id, quality as v, 1 as ver from labels union all select doc_id, case when toxic = 1 then -1 else toxic end, 2 from labels)
select doc_id, v, ver from b qualify row_number() over (partition by doc_id order by v >= 0 desc, ver desc) = 1""")
def protected_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lab,) = M.read(spark, sf_dir, "labels")
    old, new = lab.select("doc_id", F.col("quality").alias("v"), F.lit(1).alias("ver")), lab.select("doc_id", F.when(F.col("toxic") == 1, -1).otherwise(F.col("toxic")).alias("v"), F.lit(2).alias("ver"))
    return X.merge_protect(old, new, ["doc_id"], F.col("v") >= 0, "ver")[0]


@query("""select lang, run::int as run, count(*) as n from documents, (values (1), (2), (3)) r(run) where not exists (select 1 from labels l where l.doc_id = documents.doc_id and run < 3) group by all""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = M.read(spark, sf_dir, "documents", "labels")
    runs = spark.range(1, 4).select(F.col("id").cast("int").alias("run"))
    plan = X.work_plan(d.select("doc_id", "lang"), runs)
    left = X.pending(plan, lab.select("doc_id").crossJoin(runs.where("run < 3")), ["doc_id", "run"])
    return X.skips(left, ["lang", "run"])


@query("""select doc_id, text, null::varchar as level from documents""")
def blinded_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    return X.blinded_export(d, "doc_id", "text", ["level"])


@query("""select n_nationkey as key, n_name, coalesce((select list_sort(list(distinct c_mktsegment)) from customer where c_nationkey = n_nationkey), []) as segments, coalesce((select list_sort(list(distinct s_suppkey)) from supplier where s_nationkey = n_nationkey and s_acctbal > 5000), []) as rich from nation""")
def wide_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, s = M.read(spark, sf_dir, "nation", "customer", "supplier")
    return X.snapshot(n.select(F.col("n_nationkey").alias("key"), "n_name"), "key", {"segments": (c.select(F.col("c_nationkey").alias("key"), "c_mktsegment"), "c_mktsegment"), "rich": (s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("key"), "s_suppkey"), "s_suppkey")})


@query("""select (select count(*) from events where value >= 10) as done, (select count(*) from events where value < 10) as skipped, (select count(*) from events where value < 10) < 24 and (select count(*) from events where value >= 10) >= 456 as passed""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "events")
    return X.acceptance_gate(e.where("value >= 10"), e.where("value < 10"), 24, 456)


@query("""select 'http://t/c' || c_custkey as s, p, o, case when p = 'nation' then 'uri' else 'literal' end as o_kind, case when p = 'balance' then 'http://t/double' end as o_datatype, case when p = 'name' then 'en' end as o_lang
from customer, lateral (select unnest(['name', 'nation', 'balance']) as p, unnest([c_name, 'http://t/n' || c_nationkey, c_acctbal::bigint::varchar]) as o)""")
def ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as lines of statements and parsed back."""
    (c,) = M.read(spark, sf_dir, "customer")
    s = F.concat(F.lit("<http://t/c"), F.col("c_custkey").cast("string"), F.lit("> "))
    line = lambda p, o: F.concat(s, F.lit(f"<{p}> "), o, F.lit(" ."))
    lines = F.array(line("name", F.concat(F.lit('"'), "c_name", F.lit('"@en'))), line("nation", F.concat(F.lit("<http://t/n"), F.col("c_nationkey").cast("string"), F.lit(">"))), line("balance", F.concat(F.lit('"'), F.bround("c_acctbal").cast("long").cast("string"), F.lit('"^^<http://t/double>'))))
    return X.parse_ntriples(c.select(F.explode(lines).alias("value")))


# Graph


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = M.read(spark, sf_dir, "customer", "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    po = F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in (("type", F.when(F.col("c_acctbal") > 0, "Customer").otherwise("Debtor")), ("segment", F.col("c_mktsegment")), ("nation", F.col("n_name")), ("nation", F.col("c_mktsegment")))))
    return rows.select(s.alias("s"), F.inline(po))


@query("""select 'c' || c_custkey as s, c_mktsegment as segment, list_sort(list_distinct([n_name, c_mktsegment])) as nation from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0""")
def star_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.star(_triples(spark, sf_dir), "Customer", {"segment": False, "nation": True})


@query("""select 'gap' as kind, c_nationkey as key, count(*) as n from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal > 9000) group by 2
union all select 'any', n_nationkey, 1 from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 9000)
union all select 'optional', n_nationkey, count(s_suppkey) from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 9000 group by 2""")
def gap_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, s = M.read(spark, sf_dir, "nation", "customer", "supplier")
    rich = s.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("key"), "s_suppkey")
    nk = n.select(F.col("n_nationkey").alias("key"))
    gap = G.gap(c.select(F.col("c_nationkey").alias("key")), rich, "key").select(F.lit("gap").alias("kind"), "key", "n")
    some = G.having_any(nk, rich, "key").select(F.lit("any").alias("kind"), "key", F.lit(1).cast("long").alias("n"))
    opt = G.optional(nk, rich, "key").groupBy("key").agg(F.count("s_suppkey").alias("n")).select(F.lit("optional").alias("kind"), "key", "n")
    return gap.unionByName(some).unionByName(opt)


@query("""select distinct o_orderkey as item, o_orderpriority as category from orders where not exists (select 1 from lineitem, part where l_orderkey = o_orderkey and l_partkey = p_partkey and substr(p_type, 1, 1) = substr(o_orderpriority, 3, 1))""")
def no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, p = M.read(spark, sf_dir, "orders", "lineitem", "part")
    items = o.select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("category"))
    own = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("item"), F.substring("p_type", 1, 1).alias("value")).distinct()
    bridge = o.select(F.col("o_orderpriority").alias("category"), F.expr("substring(o_orderpriority, 3, 1)").alias("value")).distinct()
    return G.no_match_pair(items, own, bridge)


@query("""with recursive e as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union all select 'r' || r_regionkey, 'root' from region),
c as (select child as node, child as ancestor from e union select parent, parent from e union select c.node, e.parent from c join e on c.ancestor = e.child) select type, count(*) as n from (select distinct c_custkey, ancestor as type from customer join c on node = 'n' || c_nationkey) group by 1""")
def inherited_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = M.read(spark, sf_dir, "nation", "region", "customer")
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = n.select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent")).unionByName(r.select(tag("r", "r_regionkey").alias("child"), F.lit("root").alias("parent")))
    typed = G.inherit_type(c.select(F.col("c_custkey").alias("instance"), tag("n", "c_nationkey").alias("type")), G.closure(edges))
    return typed.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""select md5(text) as id, count(distinct doc_id) as n from documents group by 1 having count(distinct doc_id) > 1""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    return G.duplicate_keys(d.select(F.md5("text").alias("id"), "doc_id"), "id", "doc_id")


@query("""select c_mktsegment as right_, n_name as item, count(*) as n, (select count(*) from supplier where s_nationkey = n_nationkey) as tf from customer join nation on c_nationkey = n_nationkey group by all""")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, s = M.read(spark, sf_dir, "customer", "nation", "supplier")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("right_"), F.col("n_name").alias("item"), F.col("n_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    tf = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("tf"))
    return G.lookup_default(rows, tf, "k", "tf", 0).drop("k")


@query("""select l_orderkey as base_id, coalesce(nullif(l_returnflag, 'N'), o_orderstatus) as baseline, o_totalprice as price from lineitem join orders on l_orderkey = o_orderkey""")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = M.read(spark, sf_dir, "lineitem", "orders")
    v = li.select(F.col("l_orderkey").alias("base_id"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("baseline"))
    return G.variant_base(v, o.select(F.col("o_orderkey").alias("base_id"), "o_orderstatus", F.col("o_totalprice").alias("price")), "baseline", "o_orderstatus").select("base_id", "baseline", "price")


@query("""select distinct c_custkey as req from customer where c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000) and c_custkey in (select o_custkey from orders)""")
def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, o = M.read(spark, sf_dir, "customer", "supplier", "orders")
    sup = c.join(s.where("s_acctbal > 5000"), F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("c_custkey").alias("req"))
    return G.evidenced_and_grounded(sup, o.select(F.col("o_custkey").alias("req")))


@query(f"with {M.SETS} select item, list_sort(list_filter(a, lambda x: not list_contains(b, x))) as dropped, list_sort(list_filter(b, lambda x: not list_contains(a, x))) as added from s where list_sort(a) <> list_sort(b)")
def set_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.tag_sets(spark, sf_dir)
    return G.set_delta(s.select("item", F.col("a_tags").alias("tags")), s.select("item", F.col("b_tags").alias("tags")))


@query(f"with {M.SETS} select item, list_sort(list_intersect(a, b)) as inter, list_sort(list_filter(a, lambda x: not list_contains(b, x))) as diff, list_sort(list_distinct(list_concat(a, b))) as uni from s")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d, u = G.set_ops(F.col("a_tags"), F.col("b_tags"))
    return M.tag_sets(spark, sf_dir).select("item", i.alias("inter"), d.alias("diff"), u.alias("uni"))


_SEG = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"


@query("""select c_nationkey, """ + ", ".join(f"count(distinct c_custkey) filter (c_mktsegment = '{s}') as \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from customer group by 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = M.read(spark, sf_dir, "customer")
    return G.coverage_matrix(c, "c_nationkey", "c_custkey", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("""with n as (select s_nationkey, count(distinct s_suppkey) as n from supplier group by 1) select s_nationkey, n, (case when 3 * n >= 2 * max(n) over () then 1 when 3 * n >= max(n) over () then 2 else 3 end)::int as tier from n where n >= 2""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = M.read(spark, sf_dir, "supplier")
    return G.evidence_tier(G.having_count(s, "s_nationkey", "s_suppkey", 2))


@query("""select k, count(*) as n, list_sort(list(c_nationkey)) as rights from (select c_nationkey, count(distinct c_mktsegment) as k from customer where c_acctbal > 8000 group by 1) group by 1""")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = M.read(spark, sf_dir, "customer")
    return G.overlap_histogram(c.where("c_acctbal > 8000"), "c_nationkey", "c_mktsegment")


@query("""with f as (select n_name as category, (select count(*) from customer where c_nationkey = n_nationkey and c_acctbal > 9900) + (select count(*) from supplier where s_nationkey = n_nationkey) as df from nation)
select category, df, ln((sum(df) over () + 1) / (df + 1)) + 1 as idf from f""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, s = M.read(spark, sf_dir, "nation", "customer", "supplier")
    names = n.select("n_nationkey", F.col("n_name").alias("category"))
    a = c.where("c_acctbal > 9900").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("category")
    b = s.join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("category")
    return L.idf_table(G.doc_frequency([a, b], names.select("category")))


@query("""select 'all' as what, count(*) as n from lineitem union all select 'orders', count(distinct l_orderkey) from lineitem union all select 'union', count(*) from (select l_suppkey as k from lineitem union select p_partkey from part)
union all select 'minus', count(*) from (select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)) union all select 'words', count(distinct lang) + count(distinct source) from documents""")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, d = M.read(spark, sf_dir, "lineitem", "part", "documents")
    named = lambda w, df: df.select(F.lit(w).alias("what"), "n")
    keys = lambda df, k: df.select(F.col(k).cast("long").alias("k"))
    tags = lambda c: d.select(F.array(F.concat(F.lit(f"{c}:"), c)).alias("tags"))
    parts = [named("all", G.total(li)), named("orders", G.total(li, "l_orderkey")), named("union", G.total(G.union_patterns(keys(li, "l_suppkey"), keys(p, "p_partkey")))), named("minus", G.total(G.universe_minus(keys(p, "p_partkey"), keys(li.where("l_quantity > 45"), "l_partkey")))), named("words", G.total(G.vocabulary(tags("lang"), tags("source"))))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("""select p_size as number, list_sort(list(distinct p_brand)) as names from part group by 1 having count(distinct p_brand) > 1""")
def alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = M.read(spark, sf_dir, "part")
    return G.aliases(p.select(F.col("p_size").alias("number"), "p_brand"), "number", "p_brand")


@query("""select * from (select l_suppkey as id, count(distinct l_orderkey) as n, 'top' as kind from lineitem group by 1 order by 2 desc, 1 limit 15) union all select * from (select l_suppkey, count(distinct l_orderkey), 'one' from lineitem group by 1 order by 2 desc, 1 limit 1)""")
def top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = M.read(spark, sf_dir, "lineitem")
    n = G.evidence_count(li.select(F.col("l_suppkey").alias("id"), "l_orderkey"), "id", "l_orderkey")
    return G.top_n(n, "id").withColumn("kind", F.lit("top")).unionByName(G.top_one(n, "id").withColumn("kind", F.lit("one")))


@query("""with r as (select *, row_number() over (partition by c_nationkey order by c_acctbal > 5000 desc, c_custkey) as rank from customer), f as (select c_mktsegment, min(struct_pack(a := c_custkey, b := c_nationkey)) as x from customer group by 1),
m as (select distinct o_custkey, o_orderpriority from orders), q as (select o_orderpriority, o_custkey, row_number() over (partition by o_orderpriority order by o_custkey) as k from m)
select 'priority' as kind, c_nationkey::varchar as part, c_custkey::bigint as id, rank::int as rank from r where rank <= 5 union all select 'first', c_mktsegment, x.a, x.b::int from f union all select 'cap', o_orderpriority, o_custkey, 0 from q where k <= 8""")
def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = M.read(spark, sf_dir, "customer", "orders")
    a = G.priority_cap(c.withColumn("m", F.col("c_acctbal") > 5000), "c_nationkey", "m", "c_custkey", 5).select(F.lit("priority").alias("kind"), F.col("c_nationkey").cast("string").alias("part"), F.col("c_custkey").alias("id"), "rank")
    b = G.first_seen_dedupe(c.select("c_mktsegment", "c_custkey", "c_nationkey"), ["c_mktsegment"], ["c_custkey"]).select(F.lit("first").alias("kind"), F.col("c_mktsegment").alias("part"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("rank"))
    x = G.cap(o.select("o_custkey", "o_orderpriority").distinct(), "o_orderpriority", ["o_custkey"], 8).select(F.lit("cap").alias("kind"), F.col("o_orderpriority").alias("part"), F.col("o_custkey").alias("id"), F.lit(0).alias("rank"))
    return a.unionByName(b).unionByName(x)


@query("""with d as (select distinct o_orderpriority as doc, c_nationkey as grp, c_custkey as id from orders join customer on o_custkey = c_custkey), g as (select *, dense_rank() over (partition by doc order by grp) as g from d),
r as (select *, row_number() over (partition by doc, grp order by id) as r from g where g <= 6), f as (select doc, id, min(struct_pack(g := g, r := r)) as x from r where r <= 3 group by all), p as (select doc, id, row_number() over (partition by doc order by x, id) as pos from f) select doc, id, pos::int as pos from p where pos <= 8""")
def limited_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = M.read(spark, sf_dir, "orders", "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("doc"), F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id"))
    return G.limit_per_group(rows, "doc", "grp", "id")


@query("""select p_partkey, row_number() over (order by regexp_replace(p_brand, '[0-9]+', ''), regexp_extract(p_brand, '([0-9]+)', 1)::bigint, p_brand, p_partkey)::int as natural, row_number() over (order by coalesce(try_cast(regexp_extract(p_type, '([0-9]+)', 1) as int), 99), p_type, p_partkey)::int as numbered from part""")
def orders_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    (p,) = M.read(spark, sf_dir, "part")
    by = lambda *o: F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*o))
    number = F.coalesce(F.regexp_extract("p_type", "([0-9]+)", 1).try_cast("int"), F.lit(99))
    return G.sort_by_number(G.natural_sort(p, "p_brand"), "p_type").select("p_partkey", by(*G.natural_order(F.col("p_brand")), "p_partkey").alias("natural"), by(number, "p_type", "p_partkey").alias("numbered"))


@query("""with n as (select event_type, user_id % 50 as tag, count(*) as n from events group by all), r as (select *, row_number() over (partition by event_type order by n desc, tag) as rank from n) select event_type, list(tag order by rank) as tags from r where rank <= 3 group by 1""")
def common_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "events")
    return G.most_common(e.select("event_type", F.pmod("user_id", F.lit(50)).alias("tag")), "event_type", "tag")


@query("""with v as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, max(value) filter (i = n // 2) as median, max(value) filter (i = floor(0.025 * n)) as lo, max(value) filter (i = floor(0.975 * n)) as hi from v group by 1""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "events")
    return G.upper_median(e, "value", ["event_type"]).withColumnRenamed("value", "median").join(G.order_stat_ci(e, "value", ["event_type"]), "event_type")


# Lexicon and ranking


@query(f"with {_COUNTS} select doc, keyword, n::int as n, words::int as words from kc")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    return L.keyword_counts(d, KEYS)


@query(f"with {_SCORES} select doc, category, n_types, n_occ, specific, density, score from gate")
def salient_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.salience_gate(_scores(spark, sf_dir))


@query(f"""with {_COUNTS} select doc, list(keyword order by n desc, keyword) as keywords from kc group by 1""")
def sorted_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    return G.sort_keywords(L.keyword_counts(d, KEYS))


_INJECT = "inj as (select doc, '9' as category from kc where keyword in ('license', 'version', 'data') group by doc having sum(case when keyword in ('license', 'version') then n else 0 end) >= 2 or count(distinct case when keyword in ('license', 'version') then keyword end) >= 2 or bool_or(keyword = 'data'))"


@query(f"""with {_SCORES}, {_INJECT}, cats as (select doc, category from top union select doc, category from inj), kn as (select doc, category from gate where n_occ >= 3 union select doc, category from inj),
x as (select c.doc, c.category, case when k.doc is not null then coalesce(s.score, 0) else greatest(coalesce(s.score, 0), 2.0) end as score from cats c left join sc s using (doc, category) left join kn k using (doc, category))
select doc, category from x qualify row_number() over (partition by doc order by score desc, category) <= 4""")
def injected_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    counts = L.keyword_counts(d, KEYS)
    scores = L.category_scores(counts, M.lexicon(spark))
    gate_ = L.salience_gate(scores)
    inj = L.inject_category(counts, ["license", "version"], ["data"], "9")
    cats = G.union_patterns(G.top_k_per_doc(gate_).select("doc", "category"), inj)
    return L.recap_top_k(cats, scores, gate_.where("n_occ >= 3"), inj, 4)


@query("with m as (select doc_id as doc, lower(text) as low, list_distinct(list_filter([" + ", ".join(f"case when contains(lower(text), '{k}') then '{c}' end" for k, c, _ in M.LEXICON) + r""", case when regexp_matches(lower(text), 'stupid|idiot') then '9' end], lambda x: x is not null)) as c from documents),
p as (select *, case when not regexp_matches(low, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') then 'no bias word' when contains(low, 'data') then 'individual' when contains(low, 'license') then 'systemic' else 'neither' end as path from m)
select doc, list_sort(list_distinct(case path when 'systemic' then list_concat(list_filter(c, lambda x: x <> '1'), ['10', '11']) when 'individual' then list_append(c, '12') else c end)) as categories, path from p""")
def disambiguated(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    rows = L.binary_match(d, [(k, c) for k, c, _ in M.LEXICON], [(["stupid", "idiot"], "9")]).join(d.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return L.disambiguate(rows, [r"\bthe\b"], ["license"], ["data"], ["1"], ["10", "11"], ["12"])


@query("select doc_id as doc, list_sort(list_distinct(list_filter([" + ", ".join(f"case when contains(lower(text), '{k}') then '{c}' end" for k, c, _ in M.LEXICON) + ", case when regexp_matches(lower(text), 'stupid|idiot') then '99' end], lambda x: x is not null))) as categories from documents")
def presence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    return L.binary_match(d, [(k, c) for k, c, _ in M.LEXICON], [(["stupid", "idiot"], "99")])


_TF = f"with {_COUNTS}, {_LEX}, tf as (select doc, category, sum(n)::bigint as tf from kc join lex using (keyword) group by all), dfr as (select category, count(*) as df from tf group by 1)"
_POOL = """w as (select tf.doc, category, tf.tf, ln(((select sum(df) from dfr) + 1) / (df + 1)) + 1 as idf, df from tf join dfr using (category)),
a as (select *, row_number() over (partition by doc order by tf desc, category) as ra from w), b as (select *, row_number() over (partition by doc order by ra <= 2, idf desc, tf desc, category) as rb from a),
p as (select doc, category, tf, idf, df, (case when ra <= 2 then ra else 2 + rb end)::int as place, case when ra <= 2 then tf::double else idf end as score from b)"""


@query(f"{_TF}, {_POOL} select doc, category, place, 'd' || category as definition, round_even(idf, 4) as idf, round_even(score, 4) as score, tf, df from p where place <= 5")
def ranked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    hits = L.keyword_counts(d, KEYS).join(M.lexicon(spark), "keyword")
    # One row an occurrence, as the operator counts assertions.
    tags = hits.select("doc", "category", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).select("doc", "category")
    df = hits.select("doc", "category").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("df"))
    names = df.select("category", F.concat(F.lit("d"), "category").alias("definition"))
    return L.evidence_categories(tags, df, names, 5, 2)


@query(f"""with {_SCORES}, few as (select c_custkey as id, c_nationkey::varchar as category, c_acctbal > 5000 as m from customer qualify row_number() over (partition by c_nationkey order by c_acctbal > 5000 desc, c_custkey) <= 25),
rq as (select doc, id, row_number() over (partition by doc order by m desc, id) as rank from top join few using (category)), rl as (select doc, list(id order by rank) as requirements from rq where rank <= 25 group by 1),
sn as (select s_suppkey as id, s_nationkey::varchar as category from supplier qualify row_number() over (partition by s_nationkey order by s_suppkey) <= 3), g as (select doc, category, id, dense_rank() over (partition by doc order by category) as g from top join sn using (category)),
r as (select *, row_number() over (partition by doc, category order by id) as r from g where g <= 6), il as (select doc, id, row_number() over (partition by doc order by g, r, id) as pos from r where r <= 3), ii as (select doc, list(id order by pos) as incidents from il where pos <= 8 group by 1)
select doc, list_sort(list(category)) as categories, coalesce(any_value(requirements), []) as requirements, coalesce(any_value(incidents), []) as incidents from top left join rl using (doc) left join ii using (doc) group by doc""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c, s = M.read(spark, sf_dir, "documents", "customer", "supplier")
    reqs = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("category"), (F.col("c_acctbal") > 5000).alias("mandatory"))
    return retrieve_plan(d, M.lexicon(spark), KEYS, reqs, s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("category")))


_INJECT_BY = {"signals": ["license", "version"], "strong": ["data"], "category": "9"}
_BIAS = {"bias": [r"\bthe\b"], "systemic": ["license"], "individual": ["data"], "drop": ["1"], "systemic_adds": ["10", "11"], "individual_adds": ["12"]}


@query(f"""with {_SCORES}, {_INJECT}, st as (select doc, category from top union select doc, category from inj),
pa as (select doc_id as doc, case when not regexp_matches(lower(text), '\\bthe\\b') then 0 when contains(lower(text), 'data') then 2 when contains(lower(text), 'license') then 1 else 0 end as path from documents),
ch as (select doc, category from st join pa using (doc) where path <> 1 or category <> '1' union select doc, unnest(['10', '11']) from pa where path = 1 union select doc, '12' from pa where path = 2),
kn as (select doc, category from gate union select doc, category from inj), x as (select c.doc, c.category, case when k.doc is not null then coalesce(s.score, 0) else greatest(coalesce(s.score, 0), 2.0) end as score from ch c left join sc s using (doc, category) left join kn k using (doc, category)),
cats as (select doc, category from x qualify row_number() over (partition by doc order by score desc, category) <= 8),
rq as (select c_custkey as id, c_nationkey::varchar as category, 'k' || (c_custkey % 12) as risk, 'm' || c_mktsegment as mit from customer), ic as (select s_suppkey as id, s_nationkey::varchar as category, 'k' || (s_suppkey % 12) as risk from supplier),
g as (select doc, category, row_number() over (partition by doc order by category) as g from cats), r3 as (select category, id, risk, row_number() over (partition by category order by id) as r from ic),
i1 as (select doc, id, risk, g, r from g join r3 using (category) where g <= 6 and r <= 3), il as (select doc, id, risk, row_number() over (partition by doc order by g, r) as place from i1 qualify place <= 8),
ev as (select doc, risk from cats join rq using (category) union all select doc, risk from il), tf as (select doc, risk as category, count(*) as tf from ev group by all), dr as (select risk as category, count(*) as df from (select risk from rq union all select risk from ic) group by 1),
w as (select doc, category, tf, ln(((select sum(df) from dr) + 1) / (df + 1)) + 1 as idf from tf join dr using (category)), a as (select *, row_number() over (partition by doc order by tf desc, category) as ra from w),
b as (select *, row_number() over (partition by doc order by ra <= 6, idf desc, tf desc, category) as rb from a), rk as (select doc, category, tf, case when ra <= 6 then ra else 6 + rb end as place, case when ra <= 6 then tf::double else idf end as score from b)
select 'category' as part, doc, category, null::bigint as id, null::int as place, null::bigint as tf, null::double as score from cats union all select distinct 'requirement', null, category, id, null, null, null from rq join cats using (category)
union all select 'incident', doc, null, id, place, null, null from il union all select 'risk', doc, category, null, place, tf, score from rk where place <= 10 union all select distinct 'mitigation', doc, mit, null, null, null, null from cats join rq using (category)""")
def retrieve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c, s = M.read(spark, sf_dir, "documents", "customer", "supplier")
    risk = lambda k: F.array(F.concat(F.lit("k"), F.pmod(k, F.lit(12)).cast("string"))).alias("risks")
    reqs = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("category"), risk("c_custkey"), F.array(F.concat(F.lit("m"), "c_mktsegment")).alias("mitigations"))
    incs = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("category"), risk("s_suppkey"))
    return retrieve_all_plan(d, M.lexicon(spark), KEYS, reqs, incs, _INJECT_BY, _BIAS)


_STOP = ("the", "and", "of", "to", "in", "is", "that", "for")
_TERMS = r"""dt as (select doc_id as doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term, len(regexp_extract_all(lower(text), '[a-z]+')) as len from documents), c as (select doc, term, len, count(*) as tf from dt group by all),
qt as (select item_id as query, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from benchmark), q as (select query, term, count(*) as qtf from qt group by all)"""
_BM = f"""{_TERMS}, st as (select count(*) as n, avg(len(regexp_extract_all(lower(text), '[a-z]+'))) as avg_len from documents), i as (select term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as idf from c, st group by term, n), f as (select term, case when idf < 0 then 0.25 * (select avg(idf) from i) else idf end as idf from i),
s as (select query, doc, sum(f.idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) * qtf) as score from q join f using (term) join c using (term), st group by all), r as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from s)"""


def _bm25(spark: SparkSession, sf_dir: str, most: int, sizes: DataFrame | None = None) -> DataFrame:
    d, b = M.read(spark, sf_dir, "documents", "benchmark")
    return L.rank_results(P.bm25_best(L.term_counts(b, "item_id", "text", "[a-z]+"), P.build(d, "doc_id", "text"), most, sizes))


@query(f"with {_BM} select query, doc, round(score, 6) as score, rank::int as rank from r where rank <= 10")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10).where("rank <= 10").withColumn("score", F.round("score", 6))


@query(f"""with {_BM}, e as (select item_id as query, doc_id as doc from benchmark b join documents d on contains(d.text, b.text)), h as (select e.query, rank, (select count(*) from e e2 where e2.query = e.query) as size from e left join r using (query, doc)),
p as (select query, unnest([10, 25, 50, 100, 0]) as k, unnest([count(*) filter (rank <= 10) / count(*), count(*) filter (rank <= 25) / count(*), count(*) filter (rank <= 50) / count(*), count(*) filter (rank <= 100) / count(*), count(*) filter (rank <= size) / count(*)]) as v from h group by query) select k, avg(v) as recall from p group by 1""")
def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, against the BM25 ranks."""
    d, b = M.read(spark, sf_dir, "documents", "benchmark")
    expected = saved(find_passages(d, b.select(F.col("item_id").alias("query"), F.col("text").alias("passage"))), "expected")
    sizes = expected.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    return L.recall_at_k(_bm25(spark, sf_dir, 100, sizes), expected, [10, 25, 50, 100], sizes)


@query(rf"""with dt as (select doc_id as doc, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z]+'), lambda x: x not in ({', '.join(f"'{x}'" for x in _STOP)}))) as term from documents), c as (select doc, term, count(*) as tf from dt group by all),
qt as (select item_id as query, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z]+'), lambda x: x not in ({', '.join(f"'{x}'" for x in _STOP)}))) as term from benchmark), q as (select query, term, count(*) as tf from qt group by all),
i as (select term, ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from c group by 1), cw as (select doc, term, tf * idf as w from c join i using (term)), qw as (select query, term, tf * idf as w from q join i using (term)),
cn as (select doc, sqrt(sum(w * w)) as n from cw group by 1), qn as (select query, sqrt(sum(w * w)) as n from qw group by 1), s as (select query, doc, sum(qw.w * cw.w) / (any_value(qn.n) * any_value(cn.n)) as score from qw join cw using (term) join cn using (doc) join qn using (query) group by all)
select query, doc, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from s) where rank <= 10""")
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = M.read(spark, sf_dir, "documents", "benchmark")
    s = P.tfidf_best(L.term_counts(b, "item_id", "text", "[a-z][a-z]+", _STOP), P.build(d, "doc_id", "text", "[a-z][a-z]+", _STOP), 10)
    return L.rank_results(s).where("rank <= 10").withColumn("score", F.round("score", 6))


_TAGW = {"law": ["license", "version"], "data": [r"\bdata\b"], "loud": ["!!"]}
_TAGSQL = "list_filter([case when regexp_matches(lower({0}), 'license|version') then 'law' end, case when regexp_matches(lower({0}), '(^|[^\\p{{L}}\\p{{N}}_])data($|[^\\p{{L}}\\p{{N}}_])') then 'data' end, case when regexp_matches(lower({0}), '!!') then 'loud' end], lambda x: x is not null)"


@query(f"""with a as (select doc_id as doc, unnest({_TAGSQL.format('text')}) as tag from documents), b as (select c_custkey as item, unnest({_TAGSQL.format("case c_custkey % 3 when 0 then 'license' when 1 then 'data' else 'none' end")}) as tag from customer),
p as (select distinct doc, item from a join b using (tag) qualify row_number() over (partition by doc order by item) <= 100) select doc, item from (select doc, item, row_number() over (partition by doc order by item) as r from (select distinct doc, item from a join b using (tag))) where r <= 100""")
def shared_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = M.read(spark, sf_dir, "documents", "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, "license").when(F.col("c_custkey") % 3 == 1, "data").otherwise("none")
    return L.keyword_tag_filter(d.select(F.col("doc_id").alias("doc"), "text"), c.select(F.col("c_custkey").alias("item"), text.alias("text")), _TAGW)


@query("""with m as (select p_partkey as id, list_sort(list_distinct(list_filter([case when contains(lower(p_type), 'steel') then 'S' end, case when p_brand = 'Brand#11' then 'B' end, case when p_size = 7 then 'Q' end], lambda x: x is not null))) as c from part)
select id, case when len(c) > 0 then c else ['D'] end as categories from m""")
def assigned_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = M.read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("text"), F.col("p_brand").alias("section"), F.col("p_size").cast("string").alias("right"))
    return L.assign_categories(rows, [("steel", "S")], {"Brand#11": "B"}, {"7": "Q"}, "D")


# Rules


_FEAT = "f as (select doc_id as doc, list_sort(list_distinct(list_filter([" + ", ".join("case when regexp_matches(lower(text), '" + p.replace(r"\b", "@@") + f"') then '{f}' end" for p, f, _ in M.FEATURES) + "], lambda x: x is not null))) as features from documents)"
_FEAT = _FEAT.replace("@@tion", r"(?:^|[^\p{L}\p{N}_])tion").replace("@@data@@", r"(?:^|[^\p{L}\p{N}_])data(?:$|[^\p{L}\p{N}_])").replace("@@que@@", r"(?:^|[^\p{L}\p{N}_])que(?:$|[^\p{L}\p{N}_])")
_RULES = "rl(rule_id, dimension, priority, severity, any_of, all_of, none_of, compound, message) as (values " + ", ".join("('{}', '{}', {}, {}, {}, {}, {}, {}, '{}')".format(r[0], r[1], r[2] if r[2] is not None else "null::int", f"'{r[3]}'" if r[3] else "null", *(f"{x}::varchar[]" for x in r[4:8]), r[8]) for r in M.RULES) + ")"
_FOUND = "fi as (select doc, rule_id, dimension, coalesce(priority, 99) as priority, coalesce(severity, 'Violation') as severity, message, compound, all_of from f, rl where (len(any_of) = 0 or list_has_any(features, any_of)) and list_has_all(features, all_of) and not list_has_any(features, none_of))"


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    (d,) = M.read(spark, sf_dir, "documents")
    feats = R.extract_features(d, M.FEATURES)
    return feats, R.apply_rules(feats, M.rules(spark))


@query(f"with {_FEAT} select * from f")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[0]


@query(f"with {_FEAT}, {_RULES}, {_FOUND} select doc, rule_id, dimension, case when rule_id = 'r1' then 50 else priority end as priority, case when rule_id = 'r1' then 'Critical' else severity end as severity, message from fi")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlay_ = spark.createDataFrame([("r1", 50, "Critical")], "rule_id string, priority int, severity string")
    return R.apply_rules(_found(spark, sf_dir)[0], R.profile_overlay(M.rules(spark), overlay_))


@query(f"with {_FEAT}, {_RULES}, {_FOUND} select doc, rule_id, compound as dimensions, priority, severity, message from fi where len(all_of) > 0")
def compound_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.apply_compound_rules(_found(spark, sf_dir)[0], M.rules(spark))


@query(f"with {_FEAT}, {_RULES}, {_FOUND} select doc, dimension, list(rule_id order by priority, rule_id) as rules, count(*) as n from fi group by 1, 2")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile(_found(spark, sf_dir)[1]).select("doc", "dimension", F.transform("findings", lambda x: x["rule_id"]).alias("rules"), F.size("findings").cast("long").alias("n"))


@query(f"""with {_FEAT}, {_RULES}, {_FOUND}, n as (select f.doc, count(distinct dimension) as d, count(rule_id) as c from f left join fi using (doc) group by 1)
select doc, case when d >= 4 then 'High' when d >= 2 then 'Medium' else 'Low' end as by_dimension, case when c >= 4 then 'High' when c >= 2 then 'Medium' else 'Low' end as by_finding from n""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats, found = _found(spark, sf_dir)
    return R.band(feats, found).withColumnRenamed("band", "by_dimension").join(R.band(feats, found, "findings").withColumnRenamed("band", "by_finding"), "doc")


@query(f"""with {_FEAT}, {_RULES}, {_FOUND}, e as (select doc_id as doc, case when quality = 0 then ['style'] else []::varchar[] end as tags from labels), g as (select doc, list(distinct dimension) as pred from fi group by 1), x as (select doc, tags, coalesce(pred, []) as pred from e left join g using (doc))
select doc, case when len(pred) = 0 then case when len(tags) = 0 then 1.0 else 0.0 end else len(list_intersect(pred, tags)) / len(pred) end as p_a, case when len(tags) = 0 then 1.0 else len(list_intersect(pred, tags)) / len(tags) end as r_a,
case when len(tags) = 0 then 1.0 else 0.0 end as p_b, case when len(tags) = 0 then 1.0 else 0.0 end as r_b from x""")
def extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats, _ = _found(spark, sf_dir)
    (lab,) = M.read(spark, sf_dir, "labels")
    none = F.array().cast("array<string>")
    expected = lab.select(F.col("doc_id").alias("doc"), F.when(F.col("quality") == 0, F.array(F.lit("style"))).otherwise(none).alias("tags"))
    return R.compare_extractors(feats, feats.withColumn("features", none), M.rules(spark), expected)


@query("""with i as (select o_orderkey as item, list(distinct o_orderpriority) as risks, list(distinct l_suppkey % 5) as reqs, list(distinct substr(p_type, 1, 1)) filter (p_size > 25) as mits, count(*) filter (l_tax > 0.05) as free from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1),
r as (select item, unnest(risks) as risk, reqs, coalesce(mits, []) as mits, free from i), m as (select *, list_contains(mits, substr(risk, 3, 1)) as ok from r)
select substr(risk, 1, 1) as config, count(*) as n_risks, avg((len(reqs) > 0)::int) as req, avg((len(mits) > 0 or free > 0)::int) as mit, avg(ok::int) as match from m group by 1""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, p = M.read(spark, sf_dir, "orders", "lineitem", "part")
    rows = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    items = rows.groupBy(F.col("o_orderkey").alias("item")).agg(F.collect_set("o_orderpriority").alias("risks"), F.collect_set(F.pmod("l_suppkey", F.lit(5))).alias("requirements"), F.collect_set(F.when(F.col("p_size") > 25, F.substring("p_type", 1, 1))).alias("mitigations"), F.count_if(F.col("l_tax") > 0.05).alias("free_mitigations"))
    lists = o.select(F.col("o_orderpriority").alias("category")).distinct().select("category", F.array(F.substring("category", 3, 1)).alias("mitigations"))
    return R.consistency_rates(R.consistency_check(items, lists).withColumn("config", F.substring("risk", 1, 1)), "config")


@query("""select * from (values ('count', (select count(*) from (select n_nationkey from nation left join supplier on s_nationkey = n_nationkey group by 1 having count(s_suppkey) not between 1 and 6))), ('pattern', (select count(*) from part where not regexp_matches(p_brand, '^Brand#[0-9]+$'))),
('vocabulary', (select count(*) from orders where o_orderstatus not in ('F', 'O'))), ('dangling', (select count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size < 50))), ('implies', (select count(*) from lineitem where l_returnflag = 'R' and not l_linestatus = 'F')),
('orphans', (select count(*) from customer where c_custkey not in (select o_custkey from orders))), ('unique', (select count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1)))) t(rule, violations) cross join lateral (select violations = 0 as passed)""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, p, o, li, c = M.read(spark, sf_dir, "nation", "supplier", "part", "orders", "lineitem", "customer")
    line = li.withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return R.quality_report({
        "count": R.count_bounds(n.select(F.col("n_nationkey").alias("key")), s.select(F.col("s_nationkey").alias("key")), "key", 1, 6), "pattern": R.not_matching(p, "p_partkey", "p_brand", "^Brand#[0-9]+$"), "vocabulary": R.not_in(o, "o_orderkey", "o_orderstatus", ["F", "O"]),
        "dangling": R.dangling(line, "key", "l_partkey", p.where("p_size < 50"), "p_partkey"), "implies": R.implies(line, "key", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"), "orphans": R.orphans(c, "c_custkey", o, "o_custkey"), "unique": R.not_unique(line, "key"),
    })


@query("""select * from (values ('null_text', (select count(*) from documents where text is null)), ('vocab_lang', (select count(*) from documents where lang not in ('en', 'de', 'fr'))), ('range_n_chars', (select count(*) from documents where n_chars < 10 or n_chars > 50000)), ('unique', 0),
('share', (select count(*) from (select lang from documents group by 1 having count(*) > 0.6 * (select count(*) from documents)))), ('count', 1)) t("check", violations) cross join lateral (select violations = 0 as passed)""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    return R.corpus_checks(d, "doc_id", ["text"], {"lang": ["en", "de", "fr"]}, {"n_chars": (10, 50000)}, "lang", 0.6, 7)


@query("""select * from (values ('some', (select count(*) from supplier where s_acctbal > 9000) > 0, (select count(*) from supplier where s_acctbal > 9000)::varchar), ('rows', (select count(*) = 25 from nation), (select count(*)::varchar from nation)),
('keys', true, (select string_agg(r_regionkey::varchar, ',' order by r_regionkey::varchar) from region))) t(id, passed, detail)""")
def competency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = M.read(spark, sf_dir, "supplier", "nation", "region")
    return R.competency_suite({"some": s.where("s_acctbal > 9000"), "rows": n, "keys": r}, {"some": ("nonzero",), "rows": ("rows", 25), "keys": ("keys", "r_regionkey", {0, 1, 2, 3, 4})})


# Documents made of findings


@query(f"""with {_FEAT}, {_RULES}, {_FOUND}, l as (select doc, dimension, dimension || ': ' || string_agg(rule_id, '; ' order by rule_id) as line from fi group by 1, 2), t as (select doc, string_agg(line, chr(10) order by line) as text from l group by 1),
s as (select doc_id as doc, list_sort(list(distinct 'q' || quality)) as sources from labels join fi on doc = doc_id and dimension = 'privacy' group by 1) select doc, text, coalesce(sources, ['untraced']) as sources from t left join s using (doc)""")
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _found(spark, sf_dir)
    (lab,) = M.read(spark, sf_dir, "labels")
    return D.group_lines(found.select("doc", F.col("dimension").alias("category"), F.col("rule_id").alias("risk")), lab.select(F.col("doc_id").alias("doc"), F.lit("privacy").alias("category"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("id")))


@query("""with p as (select c_custkey as doc, c_name as name, case when c_acctbal > 0 then c_mktsegment else '' end as seg from customer) select authority, doc, sum(f)::bigint as filled, count(*) as total from (select 'A' as authority, doc, (length(name) > 0)::int as f from p union all select 'A', doc, (length(seg) > 0)::int from p union all select 'B', doc, 0 from p) group by 1, 2""")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = M.read(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    pool = D.build_pool(c, "c_custkey", {"name": (F.col("c_name"), none), "seg": (F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(""), F.array("c_mktsegment"))})
    pool = pool.select("doc", F.transform_values("pool", lambda k, v: v["text"]).alias("pool"))
    return D.completeness(pool, X.read_template(spark, {"A": [("name", "Name"), ("seg", "Segment")], "B": [("fax", "Fax")]}))


@query("""with r as (select c_nationkey as doc, c_custkey as id, c_name as text, row_number() over (partition by c_nationkey order by c_acctbal > 5000 desc, c_custkey) as rank from customer), t as (select doc, string_agg('[' || id || '] ' || text, chr(10) order by rank) as t from r where rank <= 25 group by 1),
s as (select s_nationkey as doc, 'suppliers: ' || string_agg(distinct s_name, ', ' order by s_name) as s from supplier group by 1) select doc, t || coalesce(chr(10) || s, '') as context from t left join s using (doc)""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = M.read(spark, sf_dir, "customer", "supplier")
    reqs = c.select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), (F.col("c_acctbal") > 5000).alias("mandatory"))
    return D.context_block(reqs, {"suppliers": s.select(F.col("s_nationkey").alias("doc"), F.col("s_name").alias("value"))})


@query(r"""with s as (select doc_id as doc, lang as authority, last_value(case when starts_with(line, 'The') then left(substr(line, 4), 20) end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row) as section, line
from (select doc_id, lang, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)) select authority, section as field, count(*) as n from s where contains(line, 'tion') group by 1, 2""")
def unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    rows = X.scan_sections(d, "doc_id", "text", "The").join(d.select(F.col("doc_id").alias("doc"), F.col("lang").alias("authority")), "doc")
    return D.unfilled_fields(rows.withColumn("section", F.left("section", F.lit(20))), "tion")


@query("""with d as (select l_orderkey as doc, list_distinct(list(distinct 's' || (l_suppkey % 18)) || list(distinct 'r' || l_returnflag) || list(distinct 'p' || (l_partkey % 100))) as f from lineitem group by 1),
r as (select 'part ' || p_partkey as rule_id, p_brand as dimension, case when p_size > 40 then null else p_size end as priority, case when p_partkey % 4 = 0 then ['p' || (p_partkey % 100), 'p' || (p_size * 2)] else [] end as a, case when p_partkey % 4 = 0 then [] else ['p' || (p_partkey % 100), 's' || (p_size % 18)] end as e,
  case when p_partkey % 4 = 0 then ['s0', 's1', 's2', 's3', 's4'] else ['rR'] end as n from part)
select doc, rule_id, dimension, coalesce(priority, 99)::int as priority, 'Violation' as severity, rule_id as message from d, r where (len(a) = 0 or list_has_any(f, a)) and list_has_all(f, e) and not list_has_any(f, n)""")
def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rules as parts, over the features of orders."""
    line, part = M.read(spark, sf_dir, "lineitem", "part")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    # Remainders are gathered as bytes and named after the shuffle, which takes half the disk of names.
    names = lambda prefix, c: F.transform(F.collect_set(c), lambda x: name(prefix, x))
    features = line.groupBy(F.col("l_orderkey").alias("doc")).agg(F.concat(names("s", (F.col("l_suppkey") % 18).cast("tinyint")), names("r", F.col("l_returnflag")), names("p", (F.col("l_partkey") % 100).cast("tinyint"))).alias("features"))
    fourth, none = F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")
    rules = part.select(
        name("part ", F.col("p_partkey")).alias("rule_id"), F.col("p_brand").alias("dimension"), F.when(F.col("p_size") <= 40, F.col("p_size")).cast("int").alias("priority"), F.lit(None).cast("string").alias("severity"),
        F.when(fourth, F.array(name("p", F.col("p_partkey") % 100), name("p", F.col("p_size") * 2))).otherwise(none).alias("any_of"), F.when(fourth, none).otherwise(F.array(name("p", F.col("p_partkey") % 100), name("s", F.col("p_size") % 18))).alias("all_of"),
        F.when(fourth, F.array(*(F.lit(f"s{k}") for k in range(5)))).otherwise(F.array(F.lit("rR"))).alias("none_of"), name("part ", F.col("p_partkey")).alias("message"),
    )
    return R.apply_rules(features, rules)


@query(f"""with t as (select doc_id, lower(text) as low, left(text, 120) as start from documents) select doc_id, regexp_matches(low, 'license|version') as law, contains(low, '!!') as loud,
array_to_string(list_filter(list_transform(string_split(start, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), ', ') as list from t""")
def flagged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = M.read(spark, sf_dir, "documents")
    return d.select("doc_id", *L.keyword_flags(F.col("text"), {"law": ["license", "version"], "loud": ["!!"]}), T.csv_join(T.csv_split(T.prefix(F.col("text"), 120))).alias("list"))


@query(f"with c as ({ORACLE['template_fill']}) select authority, avg(filled / total) as mean from c group by 1")
def mean_template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mean_completeness(template_fill(spark, sf_dir))


# Vectors

_VEC = "v as (select vec_id as id, label as grp, list_transform(embedding, lambda x: x::double) as e from embeddings), p as (select x.id as a, y.id as b, x.grp as ga, y.grp as gb, list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) as cos from v x join v y on x.id < y.id)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = M.read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))


@query(f"with {_VEC} select a, b, round(cos, 6) as cos from p where cos >= 0.3 and ga <> gb")
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.similar_pairs(_vectors(spark, sf_dir), 0.3, True).withColumn("cos", F.round("cos", 6))


@query(f"with {_VEC}, m as (select id, max(cos) as m from (select a as id, cos from p where ga <> gb union all select b, cos from p where ga <> gb) group by 1), l as (select quantile_cont(m, [0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) as x from m) select unnest([0.5, 0.75, 0.9, 0.95, 0.99, 1.0])::double as q, unnest(list_transform(x, lambda y: round(y, 6))) as value from l")
def similarity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.similarity_percentiles(_vectors(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""with recursive {_VEC}, e as (select a, b from p where cos >= 0.35), w as (select a as x, b as y from e union select b, a from e),
r as (select x, y from w union select r.x, w.y from r join w on r.y = w.x), c as (select x as id, least(x, min(y)) as root from r group by 1),
k as (select root, count(*) as n from c group by 1), m as (select root, count(*) as n_pairs from e join c on e.a = c.id group by 1)
select root, id, n, n_pairs, 2 * n_pairs = n * (n - 1) as clique from c join k using (root) join m using (root)""")
def vector_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.similar_groups(_vectors(spark, sf_dir), 0.35)


@query(f"with {_VEC} select a, b, round(cos, 6) as cos from p where cos >= 0.4")
def similar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes; the given vectors all differ, so classes are rows."""
    return S.similar_classes(_vectors(spark, sf_dir), 0.4)[0].withColumn("cos", F.round("cos", 6))


# The nearest two clusters merge, a pair a step; the row of ids -1 keeps the last merge. An edge to the merged cluster stays
# if both parts have one, with the greater distance.
_LINKAGE = f"""{_VEC}, e as (select a, b, round(1 - cos, 9) as d from p where cos >= 1 - 0.65),
s(step, a, b, d, x, y) as (select 0, a, b, d, null::bigint, null::bigint from e union all select 0, -1, -1, 9.0, null, null union all
  select step, a, b, d, x, y from (select step + 1 as step, least(na, nb) as a, greatest(na, nb) as b, max(d) as d, x, y from (
    select step, d, x, y, case when a = y then x else a end as na, case when b = y then x else b end as nb, a in (x, y) or b in (x, y) as near
    from (select step, a, b, d, first_value(a) over w as x, first_value(b) over w as y from s window w as (order by d, a, b)))
  where x >= 0 and (na <> nb or na = -1) group by step, least(na, nb), greatest(na, nb), x, y having count(*) = 2 or not bool_or(near))),
m as (select distinct x, y from s where x is not null), u as (select x as i, y as j from m union select y, x from m), r as (select i, j from u union select r.i, u.j from r join u on u.i = r.j),
g as (select i as id, least(i, min(j)) as root from r group by i), k as (select root, count(*) as n from g group by 1)"""


@query(f"with recursive {_LINKAGE} select root, id, n from g join k using (root)")
def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vector_clusters(_vectors(spark, sf_dir), 0.65)


@query(f"""with recursive {_LINKAGE}, t as (select root, count(*) as size, count(distinct grp) as kinds from g join v using (id) group by 1), c as (select size, count(*) as n, count(*) filter (kinds >= 2) as "cross" from t group by 1)
select size, n, "cross", (select sum((size - 1) * n) from c) / (select count(*) from v) as compression from c""")
def vector_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.cluster_stats(S.vector_clusters(v, 0.65), v.count(), v.select("id", "grp"))
