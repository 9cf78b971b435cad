"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws key = -ln(u) / w: u a fixed hash of its id and a seed, w its quality weight. Sorted by key within
its source, documents fill the source's budget of words: complete passes (epochs) over the source come first, then the
documents of least keys until the words left over are spent; the last one gives only the words that still fit.

No source is gathered in one place: words are summed by (source, coarse slice of the key), then by (source, fine
slice) inside the one coarse slice where the budget ends, and rows are sorted only inside the last fine slice. Slices
are even on a logarithmic scale: keys of weight w are exponential with mean 1 / w, so no coarse slice holds more than
1.6 % of a source and no fine one more than 1 in 200,000, whatever the weights are.

Defined cases: null or blank texts have size 0 and weight 0.1, are never over budget and take 0 words; a source of
size 0 has target 0; a null source is a source of its own, ranked last; repeated rows (same id) share a key, are
ordered by size and take words each on their own, in `copies`, too; an empty table gives an empty result. Input columns
named like a result column are not read except id, source and text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, words

WEIGHTS = (5.0, 2.0, 1.0)
#: Words wanted, over all words; a source gives at most EPOCHS times its own.
SHARE, EPOCHS, SEED = 1.5, 2, 17
#: Coarse slices of a doubling of the key, and fine slices of a coarse one. Keys lie between 2**-50 and 2**9.
COARSE, FINE = 16, 4_096


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """In (0, 1), from md5, so any engine can repeat it."""
    return (F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"/{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def sized(docs: DataFrame, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size (words), key, and the columns to carry. The quality weight is 0.1 plus the share of distinct
    words."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("w"), *carry)
    size = F.size("w").cast("long")
    weight = F.when(size > 0, F.size(F.array_distinct("w")) / size).otherwise(0.0) + 0.1
    return base.select("doc_id", "source", size.alias("size"), (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key"), *carry)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target): one row a source, so these windows hold as many rows as there are sources.

    With sources ordered by epochs * size / weight, those up to some rank get their cap and the rest split what is left
    by weight: the level at rank i is (total - caps before i) / weights from i on, and i is the first whose cap it
    does not exceed."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = W.partitionBy(F.lit(1))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*map(F.lit, map(float, weights))), F.pmod(rank - 1, F.lit(len(weights))))
    per = per.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * float(epochs)
    order = one.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    per = per.withColumns({"cap": cap, "ratio": cap / F.col("weight"), "total": F.sum("source_size").over(one) * F.lit(float(share))})
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", (F.col("total") - before) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("cut", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(one)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("cut"), F.col("ratio")) * F.col("weight"))
    return per.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (complete passes), rest (words of the fractional pass), taken, and
    the columns to carry, by which rows of one id and size are ordered further."""
    rows = saved(sized(docs, seed, carry), "sized")
    per = saved(targets(rows, weights, share, epochs), "targets")
    budget = F.round("target").cast("long")
    per = per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"), budget.alias("b"))
    per = per.select("source", "source_size", "target", "epochs", (F.col("b") - F.col("epochs") * F.col("source_size")).alias("rest_budget")).withColumnRenamed("source", "s")
    at = F.log2("key") * COARSE
    rows = rows.withColumns({"coarse": F.floor(at).cast("int"), "fine": F.floor((at - F.floor(at)) * FINE).cast("int")})
    one = _ends(rows.groupBy("source", "coarse").agg(F.sum("size").alias("n")), per, "coarse", F.col("rest_budget"))
    per = per.join(one, per["s"].eqNullSafe(one["e"]), "left").drop("e")
    inside = rows.join(per.select("s", F.col("coarse").alias("c"), "rest_budget", "coarse_before"), rows["source"].eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("c")))
    two = _ends(inside.groupBy("source", "fine").agg(F.sum("size").alias("n")), per, "fine", F.col("rest_budget") - F.coalesce("coarse_before", F.lit(0)))
    per = saved(per.join(two, per["s"].eqNullSafe(two["e"]), "left").drop("e").withColumnsRenamed({"coarse": "c", "fine": "f"}), "ends")
    # One row a source; Spark broadcasts it while it is under the session's limit.
    rows = rows.join(per, rows["source"].eqNullSafe(per["s"]), "left").drop("s")
    whole = (F.col("coarse") < F.col("c")) | (F.col("coarse") == F.col("c")) & (F.col("fine") < F.col("f"))
    last = (F.col("coarse") == F.col("c")) & (F.col("fine") == F.col("f"))
    rows = rows.withColumn("place", F.when(F.coalesce(last, F.lit(False)), "last").when(F.coalesce(whole, F.lit(False)), "whole").otherwise("none"))
    sorted_ = W.partitionBy("source").orderBy("key", "doc_id", "size", *carry).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest_budget") - F.col("coarse_before") - F.col("fine_before") - F.coalesce(F.sum("size").over(sorted_), F.lit(0))
    ends = rows.where("place = 'last'").withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    out = rows.where("place <> 'last'").withColumn("rest", F.when(F.col("place") == "whole", F.col("size")).otherwise(0).cast("long")).unionByName(ends)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("epochs").cast("long"), "rest", (F.col("epochs") * F.col("size") + F.col("rest")).cast("long").alias("taken"), *carry)


def _ends(sums: DataFrame, per: DataFrame, slice_: str, budget: Column) -> DataFrame:
    """The slice of each source in which its budget ends, and the words in the slices before. As many rows of a source
    meet in a window as there are slices: under 1,000 coarse ones, FINE fine ones."""
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy(slice_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    with_budget = sums.join(per.withColumn("__budget", budget).select("s", "__budget"), sums["source"].eqNullSafe(F.col("s")))
    ended = with_budget.where((F.col("before") <= F.col("__budget")) & (F.col("before") + F.col("n") > F.col("__budget")))
    found = ended.groupBy("source").agg(F.min(F.struct(slice_, "before")).alias("x"))
    return found.select(F.col("source").alias("e"), F.col(f"x.{slice_}").alias(slice_), F.col("x.before").alias(f"{slice_}_before"))


def copies(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself, with the columns that came: each document once for each complete pass over its source,
    and once more if the fractional pass takes at least half of its words (documents stay whole here). Documents without
    words are kept once.

    Rows are told apart by a hash over all their columns (maps aside), id and size, so rows that share an id keep their own
    plans. Rows alike in all that are one class of n rows: each is given an n-th of the class's copies, and what that
    leaves over, which only a class at the end of a budget has, is given to one of them."""
    alike = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    own = docs.withColumns({"__row": F.xxhash64(*alike), "__n": F.size(words(F.col("text"))).cast("long")})
    again = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + ((F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size"))).cast("long"))
    plan = mix(own, **how, carry=["__row"]).groupBy(F.col("__row").alias("__key"), F.col("doc_id").alias("__id"), F.col("size").alias("__size"))
    plan = saved(plan.agg(F.sum(again).alias("__all"), F.count(F.lit(1)).alias("__rows")).select("__key", "__id", "__size", F.expr("__all div __rows").alias("__each"), F.expr("__all % __rows").alias("__left")), "plan")

    def given(rows: DataFrame, times: str) -> DataFrame:
        wanted = plan.where(F.col(times) > 0).select("__key", "__id", "__size", times)
        return rows.join(wanted, (F.col("__row") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size")))

    out = given(own, "__each").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__each").cast("int")))).select(*docs.columns)
    if plan.where("__left > 0").limit(1).count():
        one = given(own, "__left").dropDuplicates(["__row", "doc_id", "__n"])
        out = out.unionByName(one.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__left").cast("int")))).select(*docs.columns))
    return out
