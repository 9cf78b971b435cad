"""Precision, recall and error breakdowns of sets and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_prf(pred: Column, expected: Column, convention: str = "score") -> tuple[Column, Column, Column]:
    """(precision, recall, f1) of two arrays as sets.

    "score": nothing expected has recall 1, nothing predicted precision 0. "skip": nothing expected has null recall.
    "flags": as "score", but nothing predicted has precision 1 if nothing was expected."""
    hit = F.size(F.array_intersect(pred, expected))
    n_pred, n_exp = F.size(F.array_distinct(pred)), F.size(F.array_distinct(expected))
    none = F.when(n_exp == 0, 1.0).otherwise(0.0) if convention == "flags" else F.lit(0.0)
    p = F.when(n_pred == 0, none).otherwise(hit / n_pred)
    r = F.when(n_exp == 0, F.lit(None).cast("double") if convention == "skip" else F.lit(1.0)).otherwise(hit / n_exp)
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def nan_to_null(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def nanmean(c: str | Column) -> Column:
    """Mean without nulls and NaN; NaN of nothing."""
    return F.coalesce(F.avg(nan_to_null(c)), F.lit(float("nan")))


def metric_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, min, max, n) without nulls, in one pass."""
    parts = [F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.min(F.col(m).cast("double")).alias("min"), F.max(F.col(m).cast("double")).alias("max"), F.count(m).alias("n")) for m in metrics]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def macro_mean(per_item: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return per_item.agg(*(F.avg(m).alias(m) for m in metrics))


def confusion(rows: DataFrame, labels: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Rows by actual label, columns by predicted one, the last for none of the labels."""
    p = F.when(F.col(pred).isin(*labels), F.col(pred)).otherwise("N/A")
    return rows.select(F.col(actual).alias("actual"), p.alias("p")).groupBy("actual").pivot("p", [*labels, "N/A"]).count().na.fill(0)


def per_class_prf(rows: DataFrame, labels: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1, support), 0 where undefined."""
    a, p = F.col(actual), F.col(pred)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = lambda x: F.struct(F.lit(x).alias("label"), n((a == x) & (p == x)).alias("tp"), n(p == x).alias("np"), n(a == x).alias("support"))
    rows = rows.agg(F.array(*map(one, labels)).alias("x")).select(F.inline("x"))
    pr, re_ = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    rows = rows.withColumns({"precision": pr, "recall": re_})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.select("label", "precision", "recall", f1.alias("f1"), "support")


def accuracy(rows: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    same = F.coalesce(F.lower(actual) == F.lower(pred), F.lit(False)).cast("long")
    return rows.agg(F.avg(same).alias("accuracy"), F.sum(same).alias("matches"), F.count(F.lit(1)).alias("total"))


def item_coverage(universe: DataFrame, cited: DataFrame, id_col: str, group: str) -> DataFrame:
    """(group, total, hit, pct, missed): ids of a universe that were ever cited."""
    rows = universe.join(cited.select(id_col).distinct().withColumn("_hit", F.lit(True)), id_col, "left")
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("hit"), F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col(id_col)))).alias("missed"))
    return per.select(group, "total", "hit", F.bround(100 * F.col("hit") / F.col("total"), 1).alias("pct"), "missed")


def coverage_ratio(rows: DataFrame, item: str, expected: str, got: str) -> DataFrame:
    """(item, coverage): null where nothing is expected."""
    return rows.select(item, F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, got)) / F.size(F.array_distinct(expected))).alias("coverage"))


def miss_stage(rows: DataFrame, item: str) -> DataFrame:
    """(item, tag, stage), a row for each expected tag that was not cited: never retrieved, or retrieved and lost in
    generation."""
    miss = rows.select(item, F.explode(F.array_except("expected", "cited")).alias("tag"), "retrieved")
    stage = F.when(F.array_contains("retrieved", F.col("tag")), "generation").otherwise("retrieval")
    return miss.select(item, "tag", stage.alias("stage"))


def error_taxonomy(rows: DataFrame) -> DataFrame:
    """(item, code, what), a row an error, of rows (item, level, ref_level, expected, retrieved, cited, rights, ref_rights, categories,
    ref_categories): E1 level too high, E2 too low, E3 expected not retrieved, E4 retrieved but not cited, E5 rights
    missed, E6 rights added, E7 cited beyond what was expected, E8 categories missed. One pass over the rows."""
    tagged = lambda code, a: F.transform(a, lambda t: F.struct(F.lit(code).alias("code"), t.cast("string").alias("what")))
    level = lambda code, c: F.when(c, F.array(F.struct(F.lit(code).alias("code"), F.concat_ws(">", F.col("ref_level").cast("string"), F.col("level").cast("string")).alias("what")))).otherwise(F.array().cast("array<struct<code:string,what:string>>"))
    every = F.concat(
        level("E1", F.col("level") > F.col("ref_level")), level("E2", F.col("level") < F.col("ref_level")),
        tagged("E3", F.array_except("expected", "retrieved")), tagged("E4", F.array_except(F.array_intersect("expected", "retrieved"), F.col("cited"))),
        tagged("E5", F.array_except("ref_rights", "rights")), tagged("E6", F.array_except("rights", "ref_rights")),
        tagged("E7", F.array_except("cited", "expected")), tagged("E8", F.array_except("ref_categories", "categories")),
    )
    return rows.select("item", F.inline(every))


def recall_by_group(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """(group, expected, hit, recall) of exploded expected ids, grouped by conditions on `id`."""
    ids = rows.select(F.explode("expected").alias("id"), "cited").withColumn("hit", F.array_contains("cited", F.col("id")))
    parts = [F.struct(F.lit(g).alias("group"), F.sum(c.cast("long")).alias("expected"), F.sum((c & F.col("hit")).cast("long")).alias("hit")) for g, c in groups.items()]
    return ids.agg(F.array(*parts).alias("x")).select(F.inline("x")).withColumn("recall", F.when(F.col("expected") > 0, F.col("hit") / F.col("expected")))


def hallucination_rate(rows: DataFrame) -> DataFrame:
    """One row: share of cited ids that were not retrieved, and mean precision, recall and f1 before and after dropping them."""
    kept = F.array_intersect("cited", "retrieved")
    p0, r0, f0 = set_prf(F.col("cited"), F.col("expected"))
    p1, r1, f1 = set_prf(kept, F.col("expected"))
    extra = F.size(F.array_except("cited", "retrieved"))
    return rows.agg(F.sum(extra).alias("extra"), (F.sum(extra) / F.sum(F.size(F.array_distinct("cited")))).alias("rate"), *(F.avg(c).alias(n) for c, n in ((p0, "p_before"), (r0, "r_before"), (f0, "f_before"), (p1, "p_after"), (r1, "r_after"), (f1, "f_after"))))


def cited_vs_uncited(docs: DataFrame, doc: str, limit: int = 40) -> DataFrame:
    return docs.select(doc, F.slice(F.array_except("retrieved", "cited"), 1, limit).alias("uncited"))


def evaluation_summary(docs: DataFrame, ref: DataFrame, item: str, arrays: Sequence[str]) -> DataFrame:
    """(item, expected, predicted, match, a count for each array); items without a document have an error."""
    rows = ref.join(docs, item, "left")
    counts = [F.coalesce(F.size(a), F.lit(0)).alias(f"n_{a}") for a in arrays]
    return rows.select(item, F.col("ref_label").alias("expected"), F.col("label").alias("predicted"), F.coalesce(F.lower("ref_label") == F.lower("label"), F.lit(False)).alias("match"), *counts, F.when(F.col("label").isNull(), "missing").alias("error"))


def ablation_compare(runs: DataFrame, item: str, condition: str, conditions: Sequence[str], n: str, specific: Column) -> DataFrame:
    """One row an item: for each condition the sum of `n` and whether any row has specific ids."""
    return runs.withColumn("_s", specific).groupBy(item).pivot(condition, list(conditions)).agg(F.sum(n).alias("n"), F.max("_s").alias("specific"))


def match_diversity(matches: DataFrame, wide: int = 6, thin: int = 1) -> DataFrame:
    """One row over (doc, tags, keywords): wide and thin documents and mean sizes."""
    t, k = F.size("tags"), F.size("keywords")
    return matches.agg(F.count_if(t >= wide).alias("n_wide"), F.count_if(t <= thin).alias("n_thin"), F.avg(t).alias("mean_tags"), F.avg(k).alias("mean_keywords"))


def presence_counts(matches: DataFrame) -> DataFrame:
    return matches.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, col: str, qs: Sequence[float]) -> DataFrame:
    """(q, value), exact and interpolated, and q 1 for the maximum."""
    parts = [F.struct(F.lit(float(q)).alias("q"), F.percentile(col, F.lit(q)).cast("double").alias("value")) for q in [*qs, 1.0]]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def mitigation_assign(items: DataFrame, risk_map: DataFrame) -> DataFrame:
    """(item, mitigations): the union over an item's risks of what the map (category, mitigation) names."""
    rows = items.select("item", F.explode("risks").alias("category")).join(risk_map.select("category", "mitigation").distinct(), "category")
    return rows.groupBy("item").agg(F.array_sort(F.collect_set("mitigation")).alias("mitigations"))


def unknown_risks(items: DataFrame, risk_map: DataFrame) -> DataFrame:
    return items.select(F.explode("risks").alias("category")).distinct().join(risk_map.select("category").distinct(), "category", "left_anti")


def risk_patterns(items: DataFrame) -> DataFrame:
    """(risks, n): items (item, risks) of equal sets of risks are one pattern."""
    return items.groupBy(F.array_sort(F.array_distinct("risks")).alias("risks")).agg(F.count(F.lit(1)).alias("n"))


def mitigation_usage(patterns: DataFrame, risk_map: DataFrame) -> DataFrame:
    """(mitigation, n): how many items have it among what `mitigation_assign` gives them. Of a pattern's (risks, n) risks
    that name a mitigation the first counts, so an item counts once without its mitigations being made distinct."""
    named = risk_map.select("category", "mitigation").distinct()
    naming = named.groupBy(F.col("mitigation").alias("_m")).agg(F.collect_set("category").alias("_by"))
    named = named.join(naming, named["mitigation"].eqNullSafe(naming["_m"])).select("category", "mitigation", "_by")
    rows = patterns.select("risks", "n", F.explode("risks").alias("category")).join(named, "category")
    first = rows.where(F.get(F.array_intersect("risks", "_by"), F.lit(0)) == F.col("category"))
    return first.where(F.col("mitigation").isNotNull()).groupBy("mitigation").agg(F.sum("n").alias("n"))
