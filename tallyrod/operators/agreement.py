"""Agreement between raters, reliability of labels and resampling.

Everything starts from contingency cells (group columns, a, b, n), built once; statistics are column expressions over a
few sums of them. Degenerate cases follow the named variant: "plain" kappa is 1 where chance agreement is 1 and NaN of
nothing; "strict" kappa is null in both. NaN becomes null where means are taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import divergence_note, kappa_band, spearman_brown
from ..sources.shared import saved
from .draws import binomial_table, key_number, poisson_table, quantiles, seeds, uniforms
from .graph import most_common, same_keys, upper_median, value_ranks
from .setmetrics import nan_to_null

NAN = float("nan")

# Pairs and cells


def rater_pairs(ann: DataFrame, same: Sequence[str] = (), differ: Column | None = None) -> DataFrame:
    """(item, a_*, b_*): all pairs of an item's rows with rater a < b; `same` columns must be equal."""
    cols = [c for c in ann.columns if c != "item"]
    a = ann.select("item", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = ann.select("item", *(F.col(c).alias(f"b_{c}") for c in cols))
    rows = a.join(b, "item").where(F.col("a_rater") < F.col("b_rater"))
    for c in same:
        rows = rows.where(F.col(f"a_{c}") == F.col(f"b_{c}"))
    return rows if differ is None else rows.where(differ)


def cells(pairs: DataFrame, by: Sequence[str], a: str = "a_label", b: str = "b_label", weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return pairs.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(n.alias("n"))


def _sums(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of cells: total, agreeing, and the sums over labels of (row * column), ((row + column) squared); labels per side."""
    long = table.select(*by, F.inline(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))), F.lit(0).cast("long").alias("same"))
    same = table.select(*by, F.col("a").alias("label"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).cast("long").alias("same"))
    per = long.unionByName(same).groupBy(*by, "label").agg(F.sum("x").cast("double").alias("x"), F.sum("y").cast("double").alias("y"), F.sum("same").alias("same"))
    return per.groupBy(*by).agg(
        F.sum("x").alias("total"), F.sum("same").alias("agree"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum((F.col("x") + F.col("y")) ** 2).alias("sq"),
        F.count_if(F.col("x") > 0).alias("kinds_a"), F.count_if(F.col("y") > 0).alias("kinds_b"),
    )


def _kappa() -> Column:
    po, pe = F.col("agree") / F.col("total"), F.col("xy") / (F.col("total") * F.col("total"))
    return F.when(F.col("total") == 0, NAN).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))


def _alpha() -> Column:
    n = 2 * F.col("total")
    do, de = 1 - F.col("agree") / F.col("total"), (n * n - F.col("sq")) / (n * (n - 1))
    return F.when((n <= 1) | (de == 0), NAN).otherwise(1 - do / de)


#: Name of a statistic -> its expression over the sums of cells; add to it to extend.
STATS: dict[str, Callable[[], Column]] = {"cohen": _kappa, "krippendorff": _alpha, "raw": lambda: F.when(F.col("total") == 0, NAN).otherwise(F.col("agree") / F.col("total"))}
#: Name of a ceiling estimator -> aggregate.
CEILINGS: dict[str, Callable[[str], Column]] = {"max": F.max, "mean": F.avg, "median": F.median}


def statistic(table: DataFrame, by: Sequence[str], *names: str) -> DataFrame:
    """(by, one column for each statistic)."""
    return _sums(table, by).select(*by, *(STATS[n]().alias(n) for n in names))


def cohen_kappa(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return statistic(table, by, "cohen").withColumnRenamed("cohen", "kappa")


def kappa_strict(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Null where both raters are constant; rounded to 3 digits."""
    s = _sums(table, by)
    return s.select(*by, F.when((F.col("kinds_a") > 1) | (F.col("kinds_b") > 1), F.bround(_kappa(), 3)).alias("kappa"))


def krippendorff_alpha(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return statistic(table, by, "krippendorff").withColumnRenamed("krippendorff", "alpha")


def raw_agreement(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return statistic(table, by, "raw").withColumnRenamed("raw", "share")


def binary_decisions(rows: DataFrame, by: Sequence[str], universe: int | Column, a: str = "a_tags", b: str = "b_tags") -> DataFrame:
    """Cells of the decisions item x tag, counted from set sizes; the product with the universe is never made."""
    k = F.lit(universe) if isinstance(universe, int) else universe
    both, n_a, n_b = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    s = rows.groupBy(*by).agg(F.sum(both).alias("n11"), F.sum(n_a - both).alias("n10"), F.sum(n_b - both).alias("n01"), F.sum(k - n_a - n_b + both).alias("n00"))
    cell = lambda x, y, c: F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(c).cast("long").alias("n"))
    return s.select(*by, F.inline(F.array(cell(1, 1, "n11"), cell(1, 0, "n10"), cell(0, 1, "n01"), cell(0, 0, "n00"))))


def tag_kappa(rows: DataFrame, by: Sequence[str], universe: int | Column) -> DataFrame:
    return cohen_kappa(binary_decisions(rows, by, universe), by)


def spearman_rho(rows: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, rho, n): null for fewer than two rows or where a side is constant. Rows of equal values are one cell; the ranks
    of distinct values, less their mean, are summed over cells, first by y, so that each side is ranked by itself."""
    by = list(by)
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells_ = saved(own.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("n")), "cells")
    off = F.col("_r") - (F.col("_all") + 1) / 2  # a part's mean rank
    dx = value_ranks(cells_.groupBy(*by, "_x").agg(F.sum("n").alias("n")), by, "_x", name="_r").select(*by, "_x", off.alias("dx"))
    per = cells_.alias("v").join(dx.alias("s"), same_keys("v", "s", [*by, "_x"])).select("v.*", "s.dx")
    per = per.groupBy(*by, "_y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dx")).alias("sx"), F.sum(F.col("n") * F.col("dx") * F.col("dx")).alias("xx"))
    d = value_ranks(per, by, "_y", name="_r").withColumn("dy", off)
    g = d.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("xx").alias("xx"), F.sum(F.col("n") * F.col("dy") * F.col("dy")).alias("yy"), F.sum(F.col("sx") * F.col("dy")).alias("xy"))
    return g.select(*by, F.when((F.col("n") >= 2) & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")


def all_rater_pairs(ratings: DataFrame, universe: int) -> DataFrame:
    """(a_rater, b_rater, label_kappa, tag_kappa, rho, n, band, note) of (item, rater, label, ord, tags)."""
    by = ["a_rater", "b_rater"]
    pairs = rater_pairs(ratings)
    label = kappa_strict(cells(pairs, by), by).withColumnRenamed("kappa", "label_kappa")
    tags = kappa_strict(binary_decisions(pairs, by, universe), by).withColumnRenamed("kappa", "tag_kappa")
    rho = spearman_rho(pairs, by, "a_ord", "b_ord")
    out = label.join(tags, by).join(rho, by)
    return out.withColumns({"band": kappa_band(F.col("label_kappa")), "note": divergence_note(F.col("label_kappa"), F.col("rho"))})


# Reliability: annotations are (item, rater, stratum, run, label, tags ...).


def within_pairs(ann: DataFrame) -> DataFrame:
    return rater_pairs(ann, ["stratum"])


def cross_pairs(ann: DataFrame, run: int = 1) -> DataFrame:
    return rater_pairs(ann.where(F.col("run") == run), (), F.col("a_stratum") < F.col("b_stratum"))


def within_stratum(ann: DataFrame, stat: str = "cohen", by: Sequence[str] = ()) -> DataFrame:
    """(by, stratum, mean): mean over pairs of runs; overall() takes the mean of these."""
    keys = [*by, "stratum", "a_run", "b_run"]
    pairs = within_pairs(ann).withColumn("stratum", F.col("a_stratum"))
    for k in by:
        pairs = pairs.withColumn(k, F.col(f"a_{k}"))
    return statistic(cells(pairs, keys), keys, stat).groupBy(*by, "stratum").agg(F.avg(nan_to_null(stat)).alias("mean"))


def overall(per: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per.groupBy(*by).agg(F.avg("mean").alias("mean"))


def cross_stratum(ann: DataFrame, run: int = 1, stat: str = "cohen", by: Sequence[str] = ()) -> DataFrame:
    """(by, mean) over pairs of strata on one run."""
    keys = [*by, "a_stratum", "b_stratum"]
    pairs = cross_pairs(ann, run)
    for k in by:
        pairs = pairs.withColumn(k, F.col(f"a_{k}"))
    return statistic(cells(pairs, keys), keys, stat).groupBy(*by).agg(F.avg(nan_to_null(stat)).alias("mean"))


def ceiling(within: DataFrame, estimator: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """(by, ceiling, noise_band)."""
    c = within.groupBy(*by).agg(CEILINGS[estimator]("mean").alias("ceiling"))
    return c.withColumn("noise_band", 1 - F.col("ceiling"))


def shared_items(labels: DataFrame, ref: DataFrame) -> DataFrame:
    """Assessor labels of items that every assessor has, with the reference."""
    n = labels.agg(F.count_distinct("assessor").alias("k"))
    full = labels.groupBy("item").agg(F.count_distinct("assessor").alias("c")).crossJoin(F.broadcast(n)).where("c = k").select("item")
    return labels.join(full, "item", "left_semi").join(ref, "item")


def agreement_vs_reference(labels: DataFrame, ref: DataFrame, universe: int | None = None) -> DataFrame:
    """(assessor, label_kappa, tag_kappa): against a reference (item, ref_label, ref_tags)."""
    rows = labels.join(ref, "item")
    out = cohen_kappa(cells(rows, ["assessor"], "label", "ref_label"), ["assessor"]).withColumnRenamed("kappa", "label_kappa")
    if universe is None:
        return out
    tags = cohen_kappa(binary_decisions(rows, ["assessor"], universe, "tags", "ref_tags"), ["assessor"]).withColumnRenamed("kappa", "tag_kappa")
    return out.join(tags, "assessor", "left")


def stratum_vs_reference(ann: DataFrame, ref: DataFrame, run: int = 1) -> DataFrame:
    rows = ann.where(F.col("run") == run).join(ref, "item")
    return cohen_kappa(cells(rows, ["stratum"], "label", "ref_label"), ["stratum"])


def decision_rule(scores: DataFrame, top: DataFrame, score: str = "kappa") -> DataFrame:
    """(a, b, gap, noise_band, verdict) of assessor scores; a gap equal to the band is discriminable. One row (noise_band) in
    `top`. Assessors are few."""
    a, b = scores.select(F.col("assessor").alias("a"), F.col(score).alias("x")), scores.select(F.col("assessor").alias("b"), F.col(score).alias("y"))
    rows = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(top.select("noise_band")))
    gap = F.abs(F.col("x") - F.col("y"))
    known = gap.isNotNull() & ~F.isnan(gap)
    return rows.select("a", "b", F.when(known, gap).alias("gap"), "noise_band", F.when(~known, "missing_data").when(gap < F.col("noise_band"), "not discriminable").otherwise("discriminable").alias("verdict"))


def kill_flag(verdicts: DataFrame) -> DataFrame:
    """One row: whether there are known gaps and all lie inside the band."""
    return verdicts.where("gap is not null").agg((F.count(F.lit(1)) > 0).alias("any"), F.coalesce(F.every(F.col("verdict") == "not discriminable"), F.lit(False)).alias("kill"))


# Resampling. Items with the same rows are alike, so replicates draw how often each pattern of rows occurs.


def patterns(per_item: DataFrame) -> DataFrame:
    """(pattern, h, rows, c): the distinct sorted rows that items have, a hash of them that tells them apart, the number of
    their text that fixes draws, and how many items have them."""
    cols = [c for c in per_item.columns if c != "item"]
    own = per_item.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
    lines = F.transform("rows", lambda r: F.concat_ws(",", *(F.coalesce(r[c].cast("string"), F.lit("")) for c in cols)))
    return own.groupBy("rows").agg(F.count(F.lit(1)).alias("c")).select(F.xxhash64("rows").alias("pattern"), key_number(F.array_join(F.array_sort(lines), ";")), "rows", "c")


#: Patterns that are drawn at a time: with 10,000 replicates 10 MB a matrix.
_STEP = 128


def replicate_sums(per_item: DataFrame, values: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(rep, keys, values): sums of `values` over rows (item, keys, values) by keys and replicate, in which each item has a
    weight of Poisson(1). A pattern of c items has Poisson(c), a draw that seed and pattern fix (draws.py). Items are not
    numbered and never repeated; a task holds its sums, one table of a distribution and the draws of _STEP patterns. A
    table has about 20 sqrt(c) places. Replicate -1 is the rows themselves, so that they need no second pass."""
    kept = per_item.schema
    keys = [c for c in per_item.columns if c not in ("item", *values)]
    schema = T.StructType([T.StructField("rep", T.IntegerType()), *(kept[k] for k in keys), *(T.StructField(v, T.DoubleType()) for v in values)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ab = seeds(seed, reps)
        sums: dict[tuple, np.ndarray] = {}
        last, table = None, None
        for pdf in batches:
            for start in range(0, len(pdf), _STEP):
                some = pdf.iloc[start : start + _STEP]
                weight, c = uniforms(some["h"].to_numpy(), ab), some["c"].to_numpy()
                for each in np.unique(c):  # rows come by c
                    if each != last:
                        last, table = each, poisson_table(float(each))
                    weight[c == each] = quantiles(weight[c == each], table)
                weight = np.column_stack([c, weight])
                shares: dict[tuple, np.ndarray] = {}
                for i, rows in enumerate(some["rows"]):
                    for r in rows:
                        at = shares.setdefault(tuple(r[k] for k in keys), np.zeros((len(values), len(some))))
                        at[:, i] += [r[v] for v in values]
                for k, share in shares.items():
                    sums[k] = sums.get(k, 0) + share @ weight
        for k, at in sums.items():
            yield pd.DataFrame({"rep": np.arange(-1, reps, dtype="int32")} | {n: [x] * (reps + 1) for n, x in zip(keys, k, strict=True)} | dict(zip(values, at, strict=True)))

    found = patterns(per_item).select("h", "rows", "c").repartition("h").sortWithinPartitions("c", "h").mapInPandas(run, schema)
    return found.groupBy("rep", *keys).agg(*(F.round(F.sum(v), 6).alias(v) for v in values))


def bootstrap_ci(per_item: DataFrame, stat: Callable[[DataFrame, Sequence[str]], DataFrame], reps: int, seed: int) -> DataFrame:
    """(point, lo, hi, mean) of a statistic over rows (item, ..., n). `stat(rows, by)` gives (by, value) from rows with
    their sums of n in column w. Nulls of an empty table."""
    return _ends(stat(replicate_sums(per_item, ["n"], reps, seed).withColumnRenamed("n", "w").where("w > 0"), ["rep"]))


def _ends(values: DataFrame) -> DataFrame:
    """Of (rep, value), in one aggregation: all replicates' values are one array."""
    drawn = F.when(F.col("rep") >= 0, nan_to_null("value"))
    v, n = F.col("_v"), F.size("_v")
    at = lambda q: F.get(v, F.least(F.floor(F.lit(q) * n), n - 1).cast("int"))
    out = values.agg(F.max(F.when(F.col("rep") < 0, F.col("value"))).alias("point"), F.array_sort(F.collect_list(drawn)).alias("_v"), F.avg(drawn).alias("mean"))
    return out.select("point", at(0.025).alias("lo"), at(0.975).alias("hi"), "mean")


def kappa_stat(mean_over: Sequence[str], then: Sequence[str] = ()) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """A statistic for bootstrap_ci: kappa of each group of `mean_over`, then the mean (over `then` first, if given)."""

    def of(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        keys = [*by, *mean_over]
        k = cohen_kappa(rows.groupBy(*keys, "a", "b").agg(F.sum("w").alias("n")), keys)
        if then:
            k = k.groupBy(*by, *then).agg(F.avg(nan_to_null("kappa")).alias("kappa"))
        return k.groupBy(*by).agg(F.avg(nan_to_null("kappa")).alias("value"))

    return of


def bootstrap_mean_ci(per_item: DataFrame, metric: str, reps: int, seed: int) -> DataFrame:
    """(point, lo, hi, mean) of a mean over items. Nulls of an empty table."""
    rows = per_item.where(F.col(metric).isNotNull()).select("item", F.col(metric).cast("double").alias("m"), F.lit(1.0).alias("one"))
    sums = replicate_sums(rows, ["m", "one"], reps, seed).where("one > 0")
    return _ends(sums.select("rep", (F.col("m") / F.col("one")).alias("value")))


def weighted_mean(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each row of weights."""
    return weights @ values / weights.sum(1)


def little_bootstraps_ci(per_item: DataFrame, metric: str, seed: int, stat: Callable[[np.ndarray, np.ndarray], np.ndarray] = weighted_mean, subsets: int = 20, reps: int = 400, power: float = 0.6) -> DataFrame:
    """(point, lo, hi, mean) of a statistic of real values, few of which are equal, so that patterns would not help: the bag
    of little bootstraps (Kleiner et al. 2014). Of n items, chosen by a hash, each of `subsets` subsets has about n**power;
    a replicate gives each of a subset's items a weight of Poisson(n / size), so it is as wide as one of all items, and the
    subsets' ends are averaged. `stat` takes values and a matrix of weights, a row a replicate. Draws: subsets * reps *
    n**power in all, in a task a subset, which holds n**power values (a million of 1e10 items) and some replicates at a
    time. The point is the average of the subsets' own values; for the mean it is that of all items, and the ends are
    moved by the difference."""
    rows = per_item.where(F.col(metric).isNotNull()).select(F.concat_ws(":", F.lit(str(seed)), F.col("item").cast("string")).alias("item"), F.col(metric).cast("double").alias("m"))
    rows = saved(rows.select(key_number(F.concat(F.col("item"), F.lit(":set"))).alias("place"), key_number(F.col("item")), "m"), "values")
    n = rows.count()
    size = max(1, round(n**power))
    kinds = max(1, n // size)
    chosen = rows.withColumn("subset", (F.col("place") % kinds).cast("int")).where(F.col("subset") < subsets)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "m"])
        x, h, table = pdf["m"].to_numpy(), pdf["h"].to_numpy(), poisson_table(n / len(pdf))
        a, b = seeds(seed, reps)
        some = max(1, 4_000_000 // len(x))
        got = [stat(x, quantiles(uniforms(h, (a[at : at + some], b[at : at + some])), table).T.astype("float64")) for at in range(0, reps, some)]
        v = np.sort(np.concatenate(got))
        v = v[~np.isnan(v)]
        if not len(v):
            return pd.DataFrame({"point": [], "lo": [], "hi": [], "mean": []})
        at = lambda q: float(v[min(int(q * len(v)), len(v) - 1)])
        return pd.DataFrame({"point": [float(stat(x, np.ones((1, len(x))))[0])], "lo": [at(0.025)], "hi": [at(0.975)], "mean": [float(v.mean())]})

    ends = chosen.groupBy("subset").applyInPandas(run, "point double, lo double, hi double, mean double")
    out = ends.agg(*(F.round(F.avg(c), 9).alias(c) for c in ("point", "lo", "hi", "mean")))
    if stat is weighted_mean:  # all items' mean, about which the subsets' ends are put
        whole = rows.agg(F.round(F.avg("m"), 9).alias("all")).first()["all"]  # rounded: sums differ by order
        away = F.lit(whole).cast("double") - F.col("point")
        out = out.select(F.lit(whole).cast("double").alias("point"), *(F.round(F.col(c) + away, 9).alias(c) for c in ("lo", "hi", "mean")))
    return out


def item_cells(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return pairs.groupBy("item", *by, F.col("a_label").alias("a"), F.col("b_label").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def headline_test(ann: DataFrame, reps: int, seeds: tuple[int, int]) -> DataFrame:
    """One row: within and cross agreement with intervals, and the verdict: supported only if within is larger and the
    intervals are apart; kill if it is not larger; else directional; null where either is."""
    w = item_cells(within_pairs(ann).withColumn("stratum", F.col("a_stratum")), ["stratum", "a_run", "b_run"])
    c = item_cells(cross_pairs(ann), ["a_stratum", "b_stratum"])
    a = bootstrap_ci(w, kappa_stat(["stratum", "a_run", "b_run"], ["stratum"]), reps, seeds[0]).select(*(F.col(x).alias(f"within_{x}") for x in ("point", "lo", "hi")))
    b = bootstrap_ci(c, kappa_stat(["a_stratum", "b_stratum"]), reps, seeds[1]).select(*(F.col(x).alias(f"cross_{x}") for x in ("point", "lo", "hi")))
    none = F.col("within_point").isNull() | F.col("cross_point").isNull()
    verdict = F.when(none, None).when(F.col("within_point") <= F.col("cross_point"), "kill").when(F.col("within_lo") > F.col("cross_hi"), "supported").otherwise("directional")
    return a.crossJoin(b).withColumn("verdict", verdict)


def sufficiency_split(ann: DataFrame, cut: float = 3) -> DataFrame:
    """(subset, n, within, cross): items of mean sufficiency from `cut` on, and the others; fewer than 3 items give nulls."""
    mean = ann.groupBy("item").agg(F.avg("sufficiency").alias("m")).select("item", F.when(F.col("m") >= cut, "high").otherwise("low").alias("subset"))
    rows = ann.join(mean, "item")
    n = mean.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))
    w = overall(within_stratum(rows, by=["subset"]), ["subset"]).withColumnRenamed("mean", "within")
    c = cross_stratum(rows, by=["subset"]).withColumnRenamed("mean", "cross")
    out = n.join(w, "subset", "left").join(c, "subset", "left")
    enough = F.col("n") >= 3
    return out.select("subset", "n", F.when(enough, F.col("within")).alias("within"), F.when(enough, F.col("cross")).alias("cross"))


def item_agreement(ann: DataFrame) -> DataFrame:
    """(item, agreement): share of equal pairs among an item's labels, from label counts; null for a single label."""
    n = ann.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("item").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("n"))
    return n.select("item", F.when(F.col("n") > 1, F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("agreement"))


def quadrants(ann: DataFrame, cut: float = 3) -> DataFrame:
    """(item, quadrant): agreement below its upper median or not, by sufficiency; no agreement counts as 0."""
    a = item_agreement(ann).withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))
    m = ann.groupBy("item").agg(F.avg("sufficiency").alias("m"))
    rows = a.join(m, "item").crossJoin(F.broadcast(upper_median(a, "agreement").select(F.col("value").alias("median"))))  # one row
    name = F.concat_ws(" agreement, ", F.when(F.col("agreement") < F.col("median"), "low").otherwise("high"), F.when(F.col("m") >= cut, "sufficient").otherwise("insufficient"))
    return rows.select("item", name.alias("quadrant"))


def leave_one_out(ann: DataFrame) -> DataFrame:
    """(measure, least, most) of within, cross and ceiling when one item is held out, once for each pattern of cells that
    items have. Kappa's sums change only by the pattern's own cells, so a pattern joins the margins of its own labels and
    the sums of its own groups; groups that it has no cells in keep their kappa. The driver gets a mean a stratum."""

    def held(pairs: DataFrame, keys: Sequence[str], then: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """((out, then, mean) where something changes, (then, mean) of all items)."""
        own = saved(item_cells(pairs, keys), "cells")
        all_ = saved(own.groupBy(*keys, "a", "b").agg(F.sum("n").alias("n")), "totals")
        ends = lambda rows, *more: rows.select(*more, *keys, F.inline(F.array(*(F.struct(F.col(c).alias("label"), *((F.col("n") if c == d else F.lit(0)).cast("double").alias(x) for d, x in (("a", "x"), ("b", "y"))), F.when((F.col("a") == F.col("b")) & F.lit(c == "a"), F.col("n")).otherwise(0).cast("double").alias("same")) for c in "ab"))))
        margins = ends(all_).groupBy(*keys, "label").agg(F.sum("x").alias("all_x"), F.sum("y").alias("all_y"))
        base = _sums(all_, keys).withColumn("old", nan_to_null(_kappa()))
        less = ends(patterns(own).select(F.col("pattern").alias("out"), F.inline("rows")), "out").groupBy("out", *keys, "label").agg(*(F.sum(c).alias(c) for c in ("x", "y", "same")))
        less = less.join(margins, [*keys, "label"]).groupBy("out", *keys).agg(F.sum("x").alias("t"), F.sum("same").alias("s"), F.sum(F.col("x") * F.col("all_y") + F.col("y") * F.col("all_x") - F.col("x") * F.col("y")).alias("c"))
        new = less.join(base, list(keys)).select("out", *keys, "old", (F.col("total") - F.col("t")).alias("total"), (F.col("agree") - F.col("s")).alias("agree"), (F.col("xy") - F.col("c")).alias("xy"))
        new = new.withColumn("new", nan_to_null(_kappa()))
        changed = new.groupBy("out", *then).agg((F.coalesce(F.sum("new"), F.lit(0.0)) - F.coalesce(F.sum("old"), F.lit(0.0))).alias("more"), (F.count("new") - F.count("old")).alias("more_n"))
        whole = base.groupBy(*then).agg(F.coalesce(F.sum("old"), F.lit(0.0)).alias("sum"), F.count("old").alias("n"))
        both = changed.join(whole, list(then)) if then else changed.withColumns({c: F.lit(v) for c, v in whole.first().asDict().items()})
        n = F.col("n") + F.col("more_n")
        return both.select("out", *then, F.when(n > 0, (F.col("sum") + F.col("more")) / n).alias("mean")), whole.select(*then, F.when(F.col("n") > 0, F.col("sum") / F.col("n")).alias("mean"))

    w, strata = held(within_pairs(ann).withColumn("stratum", F.col("a_stratum")), ["stratum", "a_run", "b_run"], ["stratum"])
    c, _ = held(cross_pairs(ann), ["a_stratum", "b_stratum"], [])
    ends = lambda d, v, name: d.agg(F.min(v).alias("least"), F.max(v).alias("most")).select(F.lit(name).alias("measure"), "least", "most")
    kept = [x for r in strata.collect() if r["mean"] is not None for x in (F.lit(r["stratum"]), F.lit(r["mean"]))]
    changed = w.groupBy("out").agg(F.map_from_entries(F.collect_list(F.struct("stratum", "mean"))).alias("changed"))
    rest = F.map_values(F.map_filter(F.create_map(*kept), lambda k, _: ~F.map_contains_key("changed", k))) if kept else F.array().cast("array<double>")
    means = F.filter(F.concat(rest, F.map_values("changed")), lambda x: x.isNotNull())
    per = changed.select("out", means.alias("m")).select("out", F.when(F.size("m") > 0, F.aggregate("m", F.lit(0.0), lambda a, x: a + x) / F.size("m")).alias("within"), F.array_max("m").alias("ceiling"))
    return ends(per, "within", "within").unionByName(ends(c, "mean", "cross")).unionByName(ends(per, "ceiling", "ceiling"))


def projection(rho: DataFrame, n: int, targets: Sequence[int]) -> DataFrame:
    return rho.select(F.col("mean").alias("rho"), F.explode(F.array(*map(F.lit, targets))).alias("target")).withColumn("projected", spearman_brown(F.col("rho"), F.lit(n), F.col("target")))


def spec_curve(ann: DataFrame, labels: DataFrame, ref: DataFrame, strata_sets: Mapping[str, Sequence[int]], run_sets: Mapping[str, Sequence[int]]) -> DataFrame:
    """(stat, estimator, strata, runs, ceiling, noise_band, n_discriminable): all specifications in one job; cells are built
    once and each specification picks its groups. A gap from the band on counts."""
    keys = ["stratum", "a_run", "b_run"]
    table = statistic(cells(within_pairs(ann).withColumn("stratum", F.col("a_stratum")), keys), keys, *STATS)
    long = table.select(*keys, F.inline(F.array(*(F.struct(F.lit(s).alias("stat"), nan_to_null(s).alias("value")) for s in STATS))))
    sets = F.array(*(F.struct(F.lit(k).alias("strata"), F.array(*map(F.lit, v)).alias("ss")) for k, v in strata_sets.items()))
    runs = F.array(*(F.struct(F.lit(k).alias("runs"), F.array(*map(F.lit, v)).alias("rr")) for k, v in run_sets.items()))
    rows = long.select("*", F.inline(sets)).select("*", F.inline(runs))
    rows = rows.where(F.array_contains("ss", F.col("stratum")) & F.array_contains("rr", F.col("a_run")) & F.array_contains("rr", F.col("b_run")))
    per = rows.groupBy("stat", "strata", "runs", "stratum").agg(F.avg("value").alias("mean")).groupBy("stat", "strata", "runs").agg(*(f("mean").alias(n) for n, f in CEILINGS.items()))
    ceil = per.select("stat", "strata", "runs", F.inline(F.array(*(F.struct(F.lit(n).alias("estimator"), F.col(n).alias("ceiling")) for n in CEILINGS))))
    own = labels.join(ref, "item")
    score = statistic(cells(own, ["assessor"], "label", "ref_label"), ["assessor"], *STATS).select("assessor", F.inline(F.array(*(F.struct(F.lit(s).alias("stat"), nan_to_null(s).alias("v")) for s in STATS))))
    gaps = score.alias("x").join(score.alias("y"), (F.col("x.stat") == F.col("y.stat")) & (F.col("x.assessor") < F.col("y.assessor"))).select(F.col("x.stat").alias("stat"), F.abs(F.col("x.v") - F.col("y.v")).alias("gap"))
    out = ceil.withColumn("noise_band", 1 - F.col("ceiling")).join(gaps, "stat", "left")
    return out.groupBy("stat", "estimator", "strata", "runs").agg(F.max("ceiling").alias("ceiling"), F.max("noise_band").alias("noise_band"), F.count_if(F.col("gap") >= F.col("noise_band")).alias("n_discriminable"))


def spec_summary(curve: DataFrame) -> DataFrame:
    return curve.groupBy("stat").agg(F.count(F.lit(1)).alias("specs"), F.count_if(F.col("n_discriminable") == 0).alias("none"), F.avg((F.col("n_discriminable") == 0).cast("double")).alias("share_none"))


def split_half(ann: DataFrame, labels: DataFrame, ref: DataFrame, half: Column) -> DataFrame:
    """(half, ceiling, noise_band, n_discriminable) of both halves and the full set: the half is one more group."""
    split = lambda d: d.withColumn("half", half).unionByName(d.withColumn("half", F.lit("full")))
    c = ceiling(within_stratum(split(ann), by=["half"]), by=["half"])
    k = cohen_kappa(cells(split(labels).join(ref, "item"), ["half", "assessor"], "label", "ref_label"), ["half", "assessor"])
    g = k.alias("x").join(k.alias("y"), (F.col("x.half") == F.col("y.half")) & (F.col("x.assessor") < F.col("y.assessor"))).select(F.col("x.half").alias("half"), F.abs(F.col("x.kappa") - F.col("y.kappa")).alias("gap"))
    return c.join(g, "half", "left").groupBy("half").agg(F.max("ceiling").alias("ceiling"), F.max("noise_band").alias("noise_band"), F.count_if(F.col("gap") >= F.col("noise_band")).alias("n_discriminable"))


def replicate(a: DataFrame, b: DataFrame) -> DataFrame:
    """(corpus, within, cross, ceiling, within_diff, cross_diff): two corpora side by side; differences to the first."""
    both = a.withColumn("corpus", F.lit("a")).unionByName(b.withColumn("corpus", F.lit("b")))
    w = within_stratum(both, by=["corpus"])
    out = overall(w, ["corpus"]).withColumnRenamed("mean", "within").join(cross_stratum(both, by=["corpus"]).withColumnRenamed("mean", "cross"), "corpus").join(ceiling(w, by=["corpus"]).select("corpus", "ceiling"), "corpus")
    first = W.partitionBy(F.lit(1)).orderBy("corpus")  # two rows
    return out.withColumns({f"{m}_diff": F.col(m) - F.first(m).over(first) for m in ("within", "cross")})


def stratum_profile(ann: DataFrame, top: str = "High") -> DataFrame:
    """(stratum, n, high, mean_tags, mean_sufficiency, tags): share of the top label, means, three most frequent tags."""
    a = ann.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == top).cast("double")).alias("high"), F.avg(F.size("tags")).alias("mean_tags"), F.avg("sufficiency").alias("mean_sufficiency"))
    return a.join(most_common(ann.select("stratum", F.explode("tags").alias("tag")), "stratum", "tag"), "stratum", "left")


#: Fixed value: the critical value of chi-square at 6 degrees of freedom and 1 %.
CHI_CRITICAL_6 = 16.81


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, df, n, v (Cramer's), over_critical (only at 6 degrees of freedom)."""
    n = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    one, wa, wb = W.partitionBy(F.lit(1)), W.partitionBy(a), W.partitionBy(b)  # over cells of the table
    n = n.withColumns({"ra": F.sum("o").over(wa), "rb": F.sum("o").over(wb), "t": F.sum("o").over(one)}).withColumn("e", F.col("ra") * F.col("rb") / F.col("t"))
    # Cells without rows add their expected count.
    s = n.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("x"), F.sum("e").alias("seen"), F.max("t").alias("n"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    chi, df = F.col("x") + F.col("n") - F.col("seen"), (F.col("r") - 1) * (F.col("c") - 1)
    return s.select(chi.alias("chi2"), df.alias("df"), "n", F.sqrt(chi / (F.col("n") * F.least(F.col("r") - 1, F.col("c") - 1))).alias("v"), F.when(df == 6, chi > CHI_CRITICAL_6).alias("over_critical"))


def recovery_test(ref: DataFrame, rates: Sequence[float], reps: int, labels: Sequence[str], seed: int) -> DataFrame:
    """(rate, kappa): mean agreement with a reference (item, label) of which each label was replaced, at that rate, by one
    of the others drawn evenly. Items of one label are alike, so a repetition draws how many of them turn into which other
    label, one label after the other (binomial of those left); a row a label is drawn from, whatever the number of items.
    Other labels than `labels` are left out."""
    per = ref.where(F.col("label").isin(*labels)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", "n", key_number(F.col("label")))

    def taken(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
        out = np.zeros_like(n)
        for each in np.unique(n):
            out[n == each] = quantiles(u[n == each], binomial_table(int(each), p))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, n, h in zip(pdf["label"], pdf["n"], pdf["h"], strict=True):
                others = [x for x in labels if x != label]
                for i, rate in enumerate(rates):
                    u = [uniforms(np.array([h]), seeds(f"{seed}:{i}:{step}", reps))[0] for step in range(len(others))]
                    left = taken(np.full(reps, n), rate, u[0]) if others else np.zeros(reps, dtype="int64")
                    counts = [(label, n - left)]
                    for step, to in enumerate(others, 1):
                        k = left if step == len(others) else taken(left, 1 / (len(others) - step + 1), u[step])
                        counts, left = [*counts, (to, k)], left - k
                    for to, k in counts:
                        yield pd.DataFrame({"rate": rate, "rep": np.arange(reps, dtype="int32"), "a": label, "b": to, "n": k})[k > 0]

    k = cohen_kappa(per.mapInPandas(run, "rate double, rep int, a string, b string, n long"), ["rate", "rep"])
    return k.groupBy("rate").agg(F.avg(nan_to_null("kappa")).alias("kappa"))


def is_monotone(curve: DataFrame) -> DataFrame:
    w = W.partitionBy(F.lit(1)).orderBy("rate")  # one row a rate
    return curve.withColumn("ok", F.coalesce(F.col("kappa") <= F.lag("kappa").over(w), F.lit(True))).agg(F.every("ok").alias("monotone"))


def mcnemar_exact(rows: DataFrame, a: str, b: str, ref: str) -> DataFrame:
    """(only_a, only_b, p): items that only one of two is right on; two-sided exact binomial, at most 1; 1 without any."""
    ok_a, ok_b = F.col(a) == F.col(ref), F.col(b) == F.col(ref)
    s = rows.agg(F.count_if(ok_a & ~ok_b).alias("only_a"), F.count_if(~ok_a & ok_b).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # Terms ln C(n, i) - n ln 2, each from the one before it: carried in a fold as (term, sum).
    step = lambda acc, i: F.struct((acc["term"] + F.log((n - i + 1) / i)).alias("term"), (acc["sum"] + F.exp(acc["term"] + F.log((n - i + 1) / i))).alias("sum"))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    tail = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step)["sum"]
    return s.select("only_a", "only_b", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p"))


# Variants, repeated runs, properties


def sensitivity_rates(variants: DataFrame) -> DataFrame:
    """(assessor, class, n, hits, rate) of (assessor, class, base, output) as ordinals: "positive" variants must not rise,
    "negative" ones must not fall, "neutral" ones must stay. n counts missing outputs too, which hit nothing."""
    ok = F.when(F.col("class") == "positive", F.col("output") <= F.col("base")).when(F.col("class") == "negative", F.col("output") >= F.col("base")).otherwise(F.col("output") == F.col("base"))
    g = variants.groupBy("assessor", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("hits"))
    return g.withColumn("rate", F.col("hits") / F.col("n"))


def direction_agreement(predictions: DataFrame) -> DataFrame:
    """One row (kappa, n_pairs, agree_share) of (item, rater, label, intended): pairs of raters pooled, items with a missing
    label skipped as a whole; "same" also agrees with an intended "up" or "down"."""
    whole = predictions.groupBy("item").agg(F.every(F.col("label").isNotNull()).alias("ok")).where("ok").select("item")
    rows = predictions.join(whole, "item", "left_semi")
    pairs = rater_pairs(rows.select("item", "rater", "label"))
    k = cohen_kappa(cells(pairs, [])).crossJoin(pairs.agg(F.count(F.lit(1)).alias("n_pairs")))
    hit = (F.col("label") == F.col("intended")) | (F.col("label") == "same") & F.col("intended").isin("up", "down")
    return k.crossJoin(rows.agg(F.avg(hit.cast("double")).alias("agree_share")))


def flip_rates(runs: DataFrame, n_runs: int = 5) -> DataFrame:
    """(assessor, item, mode, flip): the most frequent label (tie: first seen run) and the share of n_runs that differ from
    it; missing runs count as flips."""
    n = runs.where(F.col("label").isNotNull()).groupBy("assessor", "item", "label").agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("first"))
    top = n.groupBy("assessor", "item").agg(F.max(F.struct("c", (-F.col("first")).alias("m"), "label")).alias("x"))
    every = runs.select("assessor", "item").distinct().join(top, ["assessor", "item"], "left")
    return every.select("assessor", "item", F.col("x.label").alias("mode"), (1 - F.coalesce("x.c", F.lit(0)) / n_runs).alias("flip"))


def stability(flips: DataFrame) -> DataFrame:
    return flips.groupBy("assessor").agg(F.avg("flip").alias("mean_flip"), (1 - F.avg("flip")).alias("stability"))


def traceability(risks: DataFrame, cited: DataFrame, has_risk: DataFrame, empty_value: float) -> DataFrame:
    """(assessor, mean_share): per item the share of risks (assessor, item, category) whose category a cited requirement
    (assessor, item, id) is asserted (id, category) to have; items without risks count as empty_value."""
    shown = cited.join(has_risk, "id").select("assessor", "item", "category").distinct().withColumn("_ok", F.lit(1))
    per = risks.where(F.col("category").isNotNull()).join(shown, ["assessor", "item", "category"], "left").groupBy("assessor", "item").agg(F.avg(F.coalesce("_ok", F.lit(0))).alias("share"))
    items = risks.select("assessor", "item").unionByName(cited.select("assessor", "item")).distinct()
    return items.join(per, ["assessor", "item"], "left").groupBy("assessor").agg(F.avg(F.coalesce("share", F.lit(float(empty_value)))).alias("mean_share"))


def edit_collateral(docs: DataFrame, edits: Sequence[str], band: Callable[[Column, Sequence[str]], Column], text: str = "text", ref: str = "ref") -> DataFrame:
    """(edit, fixed, broken): with a term added to the keyword bands, documents that turn right and that turn wrong. All
    edits are columns of one pass."""
    old = band(F.col(text), ())
    rows = docs.withColumn("_old", old == F.col(ref))
    parts = [F.struct(F.lit(e).alias("edit"), F.count_if(~F.col("_old") & (band(F.col(text), (e,)) == F.col(ref))).alias("fixed"), F.count_if(F.col("_old") & (band(F.col(text), (e,)) != F.col(ref))).alias("broken")) for e in edits]
    return rows.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def score_means(scores: DataFrame) -> DataFrame:
    """(assessor, mean, n): scores kept from 1 to 5, 3 where missing."""
    s = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(F.col("score").cast("double"), F.lit(3.0))))
    return scores.groupBy("assessor").agg(F.avg(s).alias("mean"), F.count(F.lit(1)).alias("n"))


#: Below these ranges over the assessors a property says nothing.
FLAT = {"stability": 0.05, "trace": 0.05, "clarity": 1.0, "collateral": 0.3}


def property_table(stable: DataFrame, trace: DataFrame, collateral: DataFrame, clarity: DataFrame) -> DataFrame:
    """(assessor, stability, trace, collateral, clarity, degenerate, one flag flat_* for each): joined by assessor."""
    rows = stable.join(trace, "assessor", "full_outer").join(collateral, "assessor", "full_outer").join(clarity, "assessor", "full_outer")
    one = W.partitionBy(F.lit(1))  # one row an assessor
    flat = {f"flat_{k}": (F.max(k).over(one) - F.min(k).over(one)) < v for k, v in FLAT.items()}
    return rows.withColumns(flat).withColumn("degenerate", F.col("flat_stability") & F.col("flat_trace"))


def idf_rank_validation(ranks: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(category, doc, n_docs): a row for each document that has a target among its ranked categories; a target without any
    stays, with no document."""
    wanted = F.broadcast(ranks.sparkSession.createDataFrame([(t,) for t in targets], "category string"))  # the caller's short list
    hits = ranks.join(wanted, "category", "left_semi").select("category", "doc").distinct()
    hits = hits.join(hits.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs")), "category")
    return wanted.join(hits, "category", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
