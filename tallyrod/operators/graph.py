"""A graph kept as tables: patterns, gaps, closures, counts and set operations over edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import saved


def star(triples: DataFrame, type_: str, props: Mapping[str, bool], type_p: str = "type") -> DataFrame:
    """One row a subject of that type with a column for each property: the least value of a single one, a sorted array of
    a multiple one (True). One grouping, no self-join; a subject lacks the row only if it lacks the type."""
    names = [type_p, *props]
    rows = triples.where(F.col("p").isin(*names)).select("s", F.col("p"), F.col("o"))
    of = lambda p: F.when(F.col("p") == p, F.col("o"))
    columns = [(F.array_sort(F.collect_set(of(p))) if many else F.min(of(p))).alias(p) for p, many in props.items()]
    kinds = F.max((F.col("p") == type_p) & (F.col("o") == type_)).alias("_is")
    return rows.groupBy("s").agg(kinds, *columns).where("_is").drop("_is")


def optional(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    return left.join(right, key, "left")


def gap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n): keys of `left` that `right` lacks, with their rows there."""
    return left.join(right.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def having_any(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def no_match_pair(items: DataFrame, own: DataFrame, bridge: DataFrame) -> DataFrame:
    """Items (item, category) none of whose own values (item, value) is in their category's list (category, value)."""
    hit = items.join(own, "item").join(bridge, ["category", "value"]).select("item", "category").distinct()
    return items.select("item", "category").distinct().join(hit, ["item", "category"], "left_anti")


def provenance(category: str, candidates: DataFrame, has_risk: DataFrame) -> DataFrame:
    """(doc, ids): the candidates (doc, ids array) that are asserted (id, category) to have the category, in their order."""
    rows = candidates.select("doc", F.posexplode("ids").alias("pos", "id"))
    kept = rows.join(has_risk.where(F.col("category") == category).select("id").distinct(), "id", "left_semi")
    return kept.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def duplicate_keys(df: DataFrame, id_col: str, subject: str) -> DataFrame:
    """(id, n): ids that several subjects share. A grouped count takes the place of a join on "other subject"."""
    return df.groupBy(id_col).agg(F.count_distinct(subject).alias("n")).where("n > 1")


def closure(edges: DataFrame, most_rounds: int = 32) -> DataFrame:
    """(node, ancestor) over edges (child, parent), each node itself included. Round k knows the paths of up to 2**k edges
    and those of just so many; the latter, one a node in a tree, are joined to the former, which gives only paths that are
    longer, so each round makes new rows and no round makes one again, but where several ways lead to an ancestor. Rounds
    are as many as doublings of the depth; each is written to the shared folder, which ends its lineage, and nothing is
    held in memory. A cycle, whose paths never end, is an error. The rows are nodes times depth: `ancestors_of` makes only
    those of some nodes."""
    edges = saved(edges.select("child", "parent").where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct(), "edges")
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    leap = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    known = saved(nodes.select("node", F.col("node").alias("ancestor")).unionByName(leap).distinct(), "paths")
    for _ in range(most_rounds):
        first = leap.select("node", F.col("ancestor").alias("mid"))
        longer = first.join(known.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor")
        leap = saved(first.join(leap.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor").distinct(), "leaps")
        if not leap.limit(1).count():
            return known.unionByName(longer).distinct()
        known = saved(known.unionByName(longer).distinct(), "paths")
    raise RuntimeError(f"closure did not settle in {most_rounds} rounds: there is a cycle")


def ancestors_of(nodes: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, ancestor) for some nodes (node) only, each itself included: a step a round, which joins the ends that the
    round before has added. For a few nodes of a large hierarchy; a cycle's nodes are each other's ancestors."""
    edges = saved(edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("up")).distinct(), "edges")
    new = saved(nodes.select("node", F.col("node").alias("ancestor")).distinct(), "ends")
    known = new
    for _ in range(most_rounds):
        step = new.join(edges, "ancestor").select("node", F.col("up").alias("ancestor")).distinct()
        new = saved(step.join(known, ["node", "ancestor"], "left_anti"), "ends")
        if not new.limit(1).count():
            return known
        known = saved(known.unionByName(new), "known")
    raise RuntimeError(f"ancestors did not settle in {most_rounds} rounds")


def inherit_type(instances: DataFrame, closed: DataFrame) -> DataFrame:
    """(instance, type) with every type above the asserted one."""
    return instances.join(closed, instances["type"] == closed["node"]).select("instance", F.col("ancestor").alias("type")).distinct()


def lookup_default(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Adds `value` of the table's row of the key, or the default. Spark broadcasts the table while it is small."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def variant_base(variants: DataFrame, base: DataFrame, baseline: str, base_label: str) -> DataFrame:
    """Variants (base_id) with the fields of their base; a missing baseline falls back on the base's label."""
    return variants.join(base, "base_id").withColumn(baseline, F.coalesce(baseline, base_label))


def evidenced_and_grounded(supports: DataFrame, maps_to: DataFrame) -> DataFrame:
    """Requirements (req) that an incident supports and that map to a right."""
    return supports.select("req").distinct().join(maps_to.select("req").distinct(), "req", "left_semi")


def set_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(item, dropped, added) of versions (item, tags) with differing tags."""
    a, b = before.select("item", F.col("tags").alias("x")), after.select("item", F.col("tags").alias("y"))
    none = F.array().cast(before.schema["tags"].dataType)
    both = a.join(b, "item", "full_outer").withColumns({"x": F.coalesce("x", none), "y": F.coalesce("y", none)})
    out = both.select("item", F.array_sort(F.array_except("x", "y")).alias("dropped"), F.array_sort(F.array_except("y", "x")).alias("added"))
    return out.where((F.size("dropped") > 0) | (F.size("added") > 0))


# Counts


def coverage_matrix(rows: DataFrame, right: str, item: str, framework: str, frameworks: Sequence[str]) -> DataFrame:
    """Distinct items by right and framework, zero-filled."""
    return rows.groupBy(right).pivot(framework, list(frameworks)).agg(F.count_distinct(item)).na.fill(0)


def evidence_count(edges: DataFrame, right: str, item: str) -> DataFrame:
    return edges.groupBy(right).agg(F.count_distinct(item).alias("n")).orderBy(F.desc("n"), right)


def having_count(edges: DataFrame, key: str, value: str, least: int, exactly: bool = False) -> DataFrame:
    """(key, n): keys with at least, or exactly, so many distinct values."""
    n = edges.groupBy(key).agg(F.count_distinct(value).alias("n"))
    return n.where(F.col("n") == least if exactly else F.col("n") >= least)


def overlap_histogram(edges: DataFrame, right: str, framework: str) -> DataFrame:
    """(k, n, rights): rights by the number of their frameworks."""
    per = edges.groupBy(right).agg(F.count_distinct(framework).alias("k"))
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(right)).alias("rights"))


def total(df: DataFrame, distinct_col: str | None = None) -> DataFrame:
    return df.agg((F.count_distinct(distinct_col) if distinct_col else F.count(F.lit(1))).alias("n"))


def doc_frequency(edges: Sequence[DataFrame], categories: DataFrame, floors: Mapping[str, int] | None = None) -> DataFrame:
    """(category, df): assertions of each listed category over several edge tables, 0 where there is none. A category
    below its floor stops the job."""
    both = edges[0]
    for e in edges[1:]:
        both = both.unionByName(e)
    out = categories.join(both.groupBy("category").agg(F.count(F.lit(1)).alias("df")), "category", "left").select("category", F.coalesce("df", F.lit(0)).alias("df"))
    if floors:
        low = {r["category"]: r["df"] for r in out.where(F.col("category").isin(*floors)).collect() if r["df"] < floors[r["category"]]}
        if low:
            raise ValueError(f"below their floors: {low}")
    return out


# Sets


def union_patterns(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    both = a.unionByName(b)
    return both.distinct() if distinct else both


def set_ops(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(intersection, difference, union), each sorted."""
    return F.array_sort(F.array_intersect(a, b)), F.array_sort(F.array_except(a, b)), F.array_sort(F.array_union(a, b))


def universe_minus(universe: DataFrame, seen: DataFrame) -> DataFrame:
    return universe.join(seen.distinct(), universe.columns, "left_anti")


def aliases(names: DataFrame, number: str, name: str) -> DataFrame:
    """(number, names): numbers with more than one name."""
    return names.groupBy(number).agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") > 1)


def vocabulary(*sources: DataFrame) -> DataFrame:
    """(tag): all tags of sources with a column tags."""
    out = sources[0].select(F.explode("tags").alias("tag"))
    for s in sources[1:]:
        out = out.unionByName(s.select(F.explode("tags").alias("tag")))
    return out.distinct()


# Ranks and limits


def ranked(df: DataFrame, part: Sequence[str] | None, order: Sequence, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each part, with their rank. Without parts: of the whole, by a top-k that is not one task."""
    if not part:
        return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))
    return df.withColumn(name, F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col(name) <= n)


def top_k_per_doc(scores: DataFrame, k: int = 8, doc: str = "doc", score: str = "score", name: str = "category") -> DataFrame:
    return ranked(scores, [doc], [F.desc(score), name], k).drop("rank")


def limit_per_group(edges: DataFrame, doc: str, group: str, id_col: str, n: int = 3, most_groups: int = 6, most: int = 8) -> DataFrame:
    """First n ids of each of the first groups of a document; ids once each, by first occurrence; then at most `most`."""
    rows = edges.select(doc, group, id_col).distinct()
    rows = rows.withColumn("_g", F.dense_rank().over(W.partitionBy(doc).orderBy(group))).where(F.col("_g") <= most_groups)
    rows = ranked(rows, [doc, group], [id_col], n, "_r")
    first = rows.groupBy(doc, id_col).agg(F.min(F.struct("_g", "_r")).alias("_at"))
    return ranked(first, [doc], ["_at", id_col], most, "pos").drop("_at")


def priority_cap(df: DataFrame, part: str, mandatory: str, id_col: str, n: int = 25) -> DataFrame:
    return ranked(df, [part], [F.desc(mandatory), id_col], n)


def first_seen_dedupe(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c not in order]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_x"))
    return first.select(*key, *(F.col(f"_x.{c}").alias(c) for c in [*order, *rest]))


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is last by `order`."""
    rest = [c for c in df.columns if c not in key and c not in order]
    last = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_x"))
    return last.select(*key, *(F.col(f"_x.{c}").alias(c) for c in [*order, *rest]))


#: Distinct values that one task sorts; ranges that are counted at once.
SORTED, RANGES = 100_000, 64


def upper_median(df: DataFrame, col: str, part: Sequence[str] = (), most: int = SORTED) -> DataFrame:
    """(part, value): the element at place n div 2, counting from 0, of the sorted values. Equal values are counted first.
    With parts, a part's distinct values meet in a window; without, see `element_at_place`."""
    rows = df.where(F.col(col).isNotNull()).groupBy(*part, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    if not part:
        rows = saved(rows, "values")
        total = rows.agg(F.sum("_n")).first()[0] or 0
        return element_at_place(rows, total // 2, most)
    w = W.partitionBy(*part)
    rows = rows.withColumns({"_to": F.sum("_n").over(w.orderBy("value").rowsBetween(W.unboundedPreceding, 0)), "_i": F.floor(F.sum("_n").over(w) / 2)})
    return rows.where((F.col("_to") - F.col("_n") <= F.col("_i")) & (F.col("_i") < F.col("_to"))).select(*part, "value")


def element_at_place(values: DataFrame, place: int, most: int = SORTED) -> DataFrame:
    """(value), one row, or none if there are too few: the element at a place, from 0, of the sorted values (value, _n),
    each distinct and with its count. RANGES splitters are drawn by a hash, a count of each range is taken, and only the
    range that holds the place goes on, until it has at most `most` values, which one task sorts. The driver gets the
    splitters and the counts."""
    while values.limit(most + 1).count() > most:
        drawn = values.select("value").orderBy(F.xxhash64("value"), "value").limit(RANGES - 1)
        cuts = [r[0] for r in drawn.orderBy("value").collect()]
        # A value's range is the number of splitters up to it.
        number = lambda v: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= v))
        counts = {r["r"]: r["n"] for r in values.groupBy(number(F.col("value")).alias("r")).agg(F.sum("_n").alias("n")).collect()}
        for r in sorted(counts):
            if place < counts[r]:
                break
            place -= counts[r]
        else:
            return values.where("false").select("value")
        if r:
            values = values.where(F.col("value") >= F.lit(cuts[r - 1]))
        if r < len(cuts):
            values = values.where(F.col("value") < F.lit(cuts[r]))
    to = F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("value").rowsBetween(W.unboundedPreceding, 0))  # `most` rows
    return values.withColumn("_to", to).where((F.col("_to") - F.col("_n") <= place) & (F.col("_to") > place)).select("value")


def order_stat_ci(replicates: DataFrame, col: str, part: Sequence[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(part, lo, hi): elements at places int(low n) and int(high n) of the sorted values. One array of a part's values,
    of which there are as many as replicates."""
    at = lambda q: F.get(F.col("_v"), F.least(F.floor(F.lit(q) * F.size("_v")), F.size("_v") - 1).cast("int"))
    return replicates.groupBy(*part).agg(F.array_sort(F.collect_list(col)).alias("_v")).select(*part, at(low).alias("lo"), at(high).alias("hi"))


#: Rows of a slice in `running_counts`, about.
SLICE = 500_000


def running_counts(values: DataFrame, part: Sequence[str], col: str, n: str = "n", rows: int = SLICE) -> DataFrame:
    """Adds _to, the sum of n up to each of the distinct values (part, col) in order within its part, and _all, the whole
    part's. Values are cut into slices by range, of about `rows` each; a window runs inside the slice, on from the sum of
    the part's slices before, of which there is one row a slice and part. So a part that holds most values is many tasks."""
    values = saved(values, "values")
    cuts = max(1, -(-values.count() // rows))
    sliced = saved(values.repartitionByRange(cuts, *part, col).withColumn("_slice", F.spark_partition_id()), "slices")
    w = W.partitionBy(*part).orderBy("_slice")
    sums = sliced.groupBy(*part, "_slice").agg(F.sum(n).alias("_own"))
    sums = sums.withColumns({"_before": F.sum("_own").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_own"), "_all": F.sum("_own").over(W.partitionBy(*part))})
    own = sliced.alias("v").join(sums.alias("s"), same_keys("v", "s", [*part, "_slice"])).select("v.*", "s._before", "s._all")
    at = W.partitionBy(*part, "_slice").orderBy(col).rowsBetween(W.unboundedPreceding, 0)
    return own.withColumn("_to", F.col("_before") + F.sum(n).over(at)).drop("_before", "_slice")


def same_keys(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names))


def value_ranks(counts: DataFrame, part: Sequence[str], col: str, n: str = "n", name: str = "rank") -> DataFrame:
    """Adds to distinct values (part, col) with their counts n the rank of each, from 1; ties share the mean of their
    places. _all is the part's number of rows."""
    return running_counts(counts, part, col, n).withColumn(name, F.col("_to") - (F.col(n) - 1) / 2).drop("_to")


def average_rank(df: DataFrame, col: str, part: Sequence[str], name: str = "rank") -> DataFrame:
    """Ranks from 1; ties share the mean of their places. Distinct values are ranked, then joined to the rows."""
    ranks = value_ranks(df.groupBy(*part, col).agg(F.count(F.lit(1)).alias("_n")), part, col, "_n", name)
    return df.alias("v").join(ranks.alias("s"), same_keys("v", "s", [*part, col])).select("v.*", f"s.{name}")


def first_mismatches(labels: DataFrame, ref: DataFrame, n: int = 5) -> DataFrame:
    """(assessor, item): each assessor's first n items whose label is not the reference's (item, ref_label)."""
    wrong = labels.join(ref, "item").where(F.col("label") != F.col("ref_label"))
    return ranked(wrong, ["assessor"], ["item"], n).select("assessor", "item")


def evidence_tier(counts: DataFrame, n: str = "n") -> DataFrame:
    """Tier 1 from two thirds of the greatest count, 2 from one third, else 3."""
    most = F.max(n).over(W.partitionBy(F.lit(1)))  # counts have one row a right
    return counts.withColumn("tier", F.when(3 * F.col(n) >= 2 * most, 1).when(3 * F.col(n) >= most, 2).otherwise(3))


def top_n(counts: DataFrame, id_col: str, n: int = 15, count: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(count), id_col).limit(n)


def top_one(counts: DataFrame, id_col: str, count: str = "n") -> DataFrame:
    return top_n(counts, id_col, 1, count)


def sort_keywords(counts: DataFrame) -> DataFrame:
    """(doc, keywords): by falling count, then by name."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("keyword"))))
    return counts.groupBy("doc").agg(F.transform(pairs, lambda x: x["keyword"]).alias("keywords"))


def natural_order(col: Column) -> list[Column]:
    """Sort keys: the letters, then the number."""
    return [F.regexp_replace(col, "[0-9]+", ""), F.regexp_extract(col, "([0-9]+)", 1).try_cast("bigint"), col]


def natural_sort(df: DataFrame, id_col: str) -> DataFrame:
    return df.orderBy(*natural_order(F.col(id_col)))


def sort_by_number(df: DataFrame, name: str, default: int = 99) -> DataFrame:
    return df.orderBy(F.coalesce(F.regexp_extract(name, "([0-9]+)", 1).try_cast("int"), F.lit(default)), name)


def sort_by_priority(findings: DataFrame) -> DataFrame:
    return findings.orderBy("priority", "rule_id")


def cap(df: DataFrame, part: str, order: Sequence, n: int) -> DataFrame:
    return ranked(df, [part], order, n, "_r").drop("_r")


def most_common(df: DataFrame, part: str, tag: str, k: int = 3) -> DataFrame:
    """(part, tags): the k most frequent tags, ties by name."""
    n = df.groupBy(part, tag).agg(F.count(F.lit(1)).alias("n"))
    top = ranked(n, [part], [F.desc("n"), tag], k)
    return top.groupBy(part).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", tag))), lambda x: x[tag]).alias("tags"))
