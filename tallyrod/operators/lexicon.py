"""Keyword lists and ranks over texts. Lexicons, patterns and stop lists are arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_of, case_by_thresholds, contains_ci, smoothed_idf, tokens
from ..sources.shared import saved
from .graph import ranked, top_k_per_doc
from .keywords import counted

#: Scores: 100 occurrences per word count as much as one more keyword. A category is kept from LEAST_SCORE on if it has
#: LEAST_TYPES keywords, LEAST_OCCURRENCES occurrences or a topic-defining keyword.
PER_HUNDRED, LEAST_SCORE, LEAST_TYPES, LEAST_OCCURRENCES, BOOST, TOP = 100, 1.15, 2, 2, 2.0, 8


def keyword_counts(docs: DataFrame, keywords: Sequence[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, keyword, n, words), n > 0. Keywords with a blank or more than five letters count as parts of the text, others
    as beginnings of words. One pass over each text, however many keywords there are, and no join."""
    return hit_rows(counted(docs, keywords, doc, text))


def hit_rows(table: DataFrame) -> DataFrame:
    """(doc, keyword, n, words) of what `counted` has found."""
    return table.select("doc", "words", F.inline("hits")).select("doc", "keyword", "n", "words")


def category_scores(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc, category, n_types, n_occ, specific, density, score) by a lexicon (keyword, category, is_specific)."""
    per = counts.join(lexicon, "keyword").groupBy("doc", "category").agg(
        F.count_distinct("keyword").alias("n_types"), F.sum("n").alias("n_occ"), F.max("is_specific").alias("specific"), F.max("words").alias("words")
    )
    density = PER_HUNDRED * F.col("n_occ") / F.col("words")
    return per.select("doc", "category", "n_types", "n_occ", "specific", density.alias("density"), (F.col("n_types") + density).alias("score"))


def salience_gate(scores: DataFrame, min_score: float = LEAST_SCORE, min_types: int = LEAST_TYPES, min_occ: int = LEAST_OCCURRENCES) -> DataFrame:
    return scores.where((F.col("score") >= min_score) & ((F.col("n_types") >= min_types) | (F.col("n_occ") >= min_occ) | F.col("specific")))


def inject_category(counts: DataFrame, signals: Sequence[str], strong: Sequence[str], category: str) -> DataFrame:
    """(doc, category) where signal words occur twice, two of them occur, or a strong word does."""
    own = counts.where(F.col("keyword").isin(*signals, *strong)).groupBy("doc").agg(
        F.sum(F.when(F.col("keyword").isin(*signals), F.col("n")).otherwise(0)).alias("occ"),
        F.count_distinct(F.when(F.col("keyword").isin(*signals), F.col("keyword"))).alias("types"), F.max(F.col("keyword").isin(*strong)).alias("strong"),
    )
    return own.where((F.col("occ") >= 2) | (F.col("types") >= 2) | F.col("strong")).select("doc", F.lit(category).alias("category"))


def disambiguate(docs: DataFrame, bias: Sequence[str], systemic: Sequence[str], individual: Sequence[str], drop: Sequence[str], systemic_adds: Sequence[str], individual_adds: Sequence[str], doc: str = "doc", text: str = "text", categories: str = "categories") -> DataFrame:
    """(doc, categories, path): where a bias word fires, a systemic and not individual reading drops a family of categories
    and adds others; an individual one makes sure of its own; neither keeps. The path taken is returned."""
    return apply_path(docs.withColumn("path", bias_path(F.lower(text), bias, systemic, individual)), drop, systemic_adds, individual_adds, doc, categories)


def bias_path(low: Column, bias: Sequence[str], systemic: Sequence[str], individual: Sequence[str]) -> Column:
    """Which reading of a lowered text the words call for."""
    hit = lambda p: any_of(low, p)
    return F.when(~hit(bias), "no bias word").when(hit(individual), "individual").when(hit(systemic), "systemic").otherwise("neither")


def apply_path(rows: DataFrame, drop: Sequence[str], systemic_adds: Sequence[str], individual_adds: Sequence[str], doc: str = "doc", categories: str = "categories") -> DataFrame:
    values = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    new = F.when(F.col("path") == "systemic", F.array_union(F.array_except(categories, values(drop)), values(systemic_adds))).when(F.col("path") == "individual", F.array_union(categories, values(individual_adds))).otherwise(F.col(categories))
    return rows.select(doc, F.array_sort(new).alias("categories"), "path")


def recap_top_k(categories: DataFrame, scores: DataFrame, eligible: DataFrame, injected: DataFrame, k: int = TOP) -> DataFrame:
    """(doc, category): the k best; categories that are neither eligible nor injected score BOOST at least. Tie: name."""
    known = eligible.select("doc", "category").unionByName(injected.select("doc", "category")).distinct().withColumn("_known", F.lit(True))
    rows = categories.join(scores.select("doc", "category", "score"), ["doc", "category"], "left").join(known, ["doc", "category"], "left")
    score = F.coalesce("score", F.lit(0.0))
    rows = rows.withColumn("score", F.when(F.col("_known"), score).otherwise(F.greatest(score, F.lit(BOOST))))
    return top_k_per_doc(rows, k).select("doc", "category")


def binary_match(docs: DataFrame, lexicon: Sequence[tuple[str, str]], soft: Sequence[tuple[Sequence[str], str]] = (), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, categories): categories with a keyword anywhere in the text, and soft ones with any of their words."""
    low = F.lower(text)
    marks = [F.when(low.contains(k), F.lit(c)) for k, c in lexicon] + [F.when(any_of(low, ws), F.lit(c)) for ws, c in soft]
    return docs.select(F.col(doc).alias("doc"), F.array_sort(F.array_distinct(F.array_compact(F.array(*marks)))).alias("categories"))


def keyword_band(text: Column, high: Sequence[str], medium: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.when(any_of(low, high), "High").when(any_of(low, medium), "Medium").otherwise("Low")


def keyword_flags(text: Column, words: Mapping[str, Sequence[str]]) -> list[Column]:
    return [any_of(F.lower(text), ws).alias(name) for name, ws in words.items()]


def keyword_tags(text: Column, words: Mapping[str, Sequence[str]]) -> Column:
    return F.array_compact(F.array(*(F.when(any_of(F.lower(text), ws), F.lit(name)) for name, ws in words.items())))


def keyword_tag_filter(docs: DataFrame, items: DataFrame, words: Mapping[str, Sequence[str]], n: int = 100) -> DataFrame:
    """(doc, item): items (item, text) that share a tag with the document (doc, text), the first n. Documents of equal sets
    of tags have the same items, so the first n are taken of each tag, then of each set, and only then joined to documents."""
    a = docs.select("doc", F.explode(keyword_tags(F.col("text"), words)).alias("tag")).groupBy("doc").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    b = items.select("item", F.explode(keyword_tags(F.col("text"), words)).alias("tag")).distinct()
    a, b = saved(a, "tagged"), ranked(b, ["tag"], ["item"], n)
    sets = a.select("tags").distinct().select("tags", F.explode("tags").alias("tag"))
    first = ranked(sets.join(b, "tag").select("tags", "item").distinct(), ["tags"], ["item"], n)
    return a.join(first, "tags").select("doc", "item")


def assign_categories(rows: DataFrame, by_text: Sequence[tuple[str, str]], by_section: Mapping[str, str], by_right: Mapping[str, str], default: str, section: str = "section", right: str = "right", text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, categories): those that rules on text, section and right give, or the default."""
    marks = [F.when(contains_ci(F.col(text), k), F.lit(c)) for k, c in by_text]
    marks += [F.when(F.col(section) == k, F.lit(c)) for k, c in by_section.items()] + [F.when(F.col(right) == k, F.lit(c)) for k, c in by_right.items()]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*marks))))
    return rows.select(id_col, F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default))).alias("categories"))


def top_up(assigned: DataFrame, categories: DataFrame, default: str, least: int = 3, id_col: str = "id") -> DataFrame:
    """(id, category): the assignments, and for each category with fewer than `least` as many of the items that have only
    the default, in order of id."""
    have = assigned.select(id_col, F.explode("categories").alias("category"))
    short = categories.join(have.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").select("category", (least - F.coalesce("n", F.lit(0))).alias("short")).where("short > 0")
    free = assigned.where((F.size("categories") == 1) & (F.col("categories")[0] == default)).select(id_col)
    free = ranked(free, None, [id_col], least * 1000, "_i")
    ends = short.withColumn("_to", F.sum("short").over(W.partitionBy(F.lit(1)).orderBy("category").rowsBetween(W.unboundedPreceding, 0)))  # one row a category
    more = free.join(ends, (F.col("_i") <= F.col("_to")) & (F.col("_i") > F.col("_to") - F.col("short"))).select(id_col, "category")
    return have.unionByName(more)


# Ranking


def two_pool_rank(rows: DataFrame, top: int = 10, primary: int = 6) -> DataFrame:
    """Of (doc, category, tf, idf): the `primary` by tf then name, filled up to `top` from the rest by idf, tf, name; score
    is tf in the first pool, idf in the second."""
    w = W.partitionBy("doc")
    rows = rows.withColumn("_a", F.row_number().over(w.orderBy(F.desc("tf"), "category")))
    rows = rows.withColumn("_b", F.when(F.col("_a") > primary, F.row_number().over(w.orderBy(F.col("_a") <= primary, F.desc("idf"), F.desc("tf"), "category"))))
    place = F.when(F.col("_a") <= primary, F.col("_a")).otherwise(primary + F.col("_b"))
    score = F.when(F.col("_a") <= primary, F.col("tf").cast("double")).otherwise(F.col("idf"))
    return rows.select("doc", "category", "tf", "idf", place.alias("place"), score.alias("score")).where(F.col("place") <= top)


def idf_table(df: DataFrame) -> DataFrame:
    """(category, df, idf) where N is the sum of df."""
    n = F.sum("df").over(W.partitionBy(F.lit(1)))  # one row a category
    return df.select("category", "df", smoothed_idf(F.col("df"), n).alias("idf"))


def evidence_categories(tags: DataFrame, df: DataFrame, definitions: DataFrame, top: int = 10, primary: int = 6) -> DataFrame:
    """Of (doc, category) occurrences: the ranked categories with definition, idf, score, tf and df. Unknown ones count as df 1."""
    tf = tags.groupBy("doc", "category").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("total"))
    rows = tf.join(df, "category", "left").crossJoin(F.broadcast(n)).withColumn("df", F.coalesce("df", F.lit(1)))
    rows = rows.withColumn("idf", smoothed_idf(F.col("df"), F.col("total")))
    out = two_pool_rank(rows.select("doc", "category", "tf", "idf"), top, primary).join(definitions, "category", "left")
    out = out.join(df, "category", "left")
    return out.select("doc", "category", "place", F.coalesce("definition", F.lit("")).alias("definition"), F.bround("idf", 4).alias("idf"), F.bround("score", 4).alias("score"), "tf", F.coalesce("df", F.lit(1)).alias("df"))


def term_counts(docs: DataFrame, id_col: str, text: str, pattern: str, stop: Sequence[str] = ()) -> DataFrame:
    """(doc, term, tf, len): terms of each text; len counts all of them."""
    toks = tokens(F.col(text), pattern)
    if stop:
        toks = F.filter(toks, lambda t: ~t.isin(*stop))
    rows = docs.select(F.col(id_col).alias("doc"), toks.alias("_t")).select("doc", F.size("_t").alias("len"), F.explode("_t").alias("term"))
    return rows.groupBy("doc", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def rank_results(scores: DataFrame, digits: int = 9) -> DataFrame:
    """Adds rank within a query: by falling score (rounded, so that sums in another order rank alike), ties by doc."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", digits)), "doc")))


def recall_at_k(ranks: DataFrame, expected: DataFrame, ks: Sequence[int], matched: DataFrame | None = None) -> DataFrame:
    """(k, recall): mean over queries of the share of expected docs ranked up to k; k 0 stands for each query's own size
    in `matched` (query, size)."""
    hits = expected.join(ranks.select("query", "doc", "rank"), ["query", "doc"], "left")
    size = F.count(F.lit(1))
    if matched is not None:
        hits = hits.join(matched, "query", "left")
    shares = [(F.sum((F.col("rank") <= k).cast("int")) / size).alias(f"r{k}") for k in ks]
    if matched is not None:
        shares.append((F.sum((F.col("rank") <= F.col("size")).cast("int")) / size).alias("r0"))
    per = hits.groupBy("query").agg(*shares)
    names = [*ks, *([0] if matched is not None else [])]
    out = per.agg(*(F.avg(F.coalesce(f"r{k}", F.lit(0.0))).alias(f"r{k}") for k in names))
    return out.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in names))))

