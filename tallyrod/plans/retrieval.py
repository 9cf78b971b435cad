"""From texts to requirements and incidents in one plan.

What a document gets depends on its set of categories alone. So it is worked out once for each set that occurs, and joined
to documents last; no table in between has a row for each requirement of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import limit_per_group, priority_cap, ranked, top_k_per_doc
from ..operators.keywords import counted
from ..operators.lexicon import apply_path, bias_path, category_scores, hit_rows, inject_category, keyword_counts, recap_top_k, salience_gate, smoothed_idf, two_pool_rank
from ..sources.shared import saved


def _sets(top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, categories), (doc, category)) of (doc, category): each document's set in order of name; and the members of
    each set that occurs, which stands for the document there."""
    cats = saved(top.groupBy("doc").agg(F.array_sort(F.collect_list("category")).alias("categories")), "sets")
    return cats, saved(cats.select("categories").distinct().select(F.col("categories").alias("doc"), F.explode("categories").alias("category")), "members")


def retrieve(docs: DataFrame, lexicon: DataFrame, keywords: list[str], requirements: DataFrame, incidents: DataFrame, most: int = 25) -> DataFrame:
    """(doc, categories, requirements, incidents) of documents (doc_id, text): the best categories, their requirements (id,
    category, mandatory), mandatory first, and incidents (id, category), three a category, six categories, eight in all.

    Both tables are cut to what one category can contribute before they are joined, so a document's rows are bounded: this
    is the view that fits a prompt. `retrieve_all` keeps all requirements."""
    cats, top = _sets(top_k_per_doc(salience_gate(category_scores(keyword_counts(docs, keywords), lexicon))).select("doc", "category"))
    few = ranked(requirements, ["category"], [F.desc("mandatory"), "id"], most, "_r").drop("_r")
    reqs = priority_cap(top.join(few, "category"), "doc", "mandatory", "id", most)
    reqs = reqs.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("requirements"))
    near = ranked(incidents, ["category"], ["id"], 3, "_r").drop("_r")
    incs = limit_per_group(top.join(near, "category"), "doc", "category", "id")
    incs = incs.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("incidents"))
    of = top.select("doc").distinct().join(reqs, "doc", "left").join(incs, "doc", "left").withColumnRenamed("doc", "categories")
    none = F.array().cast("array<bigint>")
    got = lambda c: F.coalesce(F.when(F.col("doc").isNotNull(), F.col(c)), none).alias(c)  # noqa: E731  a null document has no lists
    return cats.join(saved(of, "lists"), "categories", "left").select("doc", "categories", got("requirements"), got("incidents"))


def matched(docs: DataFrame, lexicon: DataFrame, keywords: list[str], inject: dict, bias: dict) -> DataFrame:
    """(doc, category): the best categories, an injected one, those that disambiguation drops or adds, then the best again.
    One pass over the texts writes each document's keywords and its path of disambiguation; the rest reads that table."""
    table = saved(counted(docs, keywords, path=lambda low: bias_path(low, bias["bias"], bias["systemic"], bias["individual"])), "counted")
    counts = hit_rows(table)
    scores = saved(category_scores(counts, lexicon), "scores")
    gate = salience_gate(scores)
    extra = inject_category(counts, inject["signals"], inject["strong"], inject["category"])
    start = top_k_per_doc(gate).select("doc", "category").unionByName(extra).distinct()
    path = table.groupBy("doc").agg(F.max("path").alias("path"))
    rows = path.join(start.groupBy("doc").agg(F.collect_list("category").alias("categories")), "doc", "left")
    rows = rows.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    chosen = apply_path(rows, bias["drop"], bias["systemic_adds"], bias["individual_adds"]).select("doc", F.explode("categories").alias("category"))
    return recap_top_k(chosen, scores, gate, extra)


def retrieve_all(docs: DataFrame, lexicon: DataFrame, keywords: list[str], requirements: DataFrame, incidents: DataFrame, inject: dict, bias: dict) -> DataFrame:
    """(part, doc, category, id, place, tf, score) of documents (doc_id, text), requirements (id, category, risks, mitigations)
    and incidents (id, category, risks):

    category: the document's categories. requirement: every distinct requirement of a matched category, once a category and
    without a document, which has those of all its categories. incident: three a category, the first six categories,
    eight in all. risk: ten risk categories of its requirements and incidents, ranked in two pools. mitigation: the distinct
    ones of its requirements, in order of name."""
    found = saved(matched(docs, lexicon, keywords, inject, bias), "matched")
    cats, top = _sets(found)
    reqs = requirements.select("category", "id").distinct().join(top.select("category").distinct(), "category", "left_semi")
    # Requirements of equal sets of categories belong to the same documents: they are counted before documents are joined.
    own = requirements.select("id", "category").distinct().groupBy("id").agg(F.array_sort(F.collect_set("category")).alias("cats"))
    of = lambda t, c: t.select("id", F.explode(c).alias("name")).distinct()
    risks = of(requirements, "risks").join(own, "id").groupBy("cats", "name").agg(F.count(F.lit(1)).alias("tf"))
    measures = of(requirements, "mitigations").join(own, "id").select("cats", "name").distinct()
    member = top.join(own.select("cats").distinct().select("cats", F.explode("cats").alias("category")), "category").select("doc", "cats").distinct()
    # Distinct before any limit. A category without incidents still is one of the first six.
    first = ranked(top, ["doc"], ["category"], 6, "_g")
    near = ranked(incidents.select("category", "id").distinct(), ["category"], ["id"], 3, "_r")
    incs = first.join(near, "category").groupBy("doc", "id").agg(F.min(F.struct("_g", "_r")).alias("_at"))
    incs = ranked(incs, ["doc"], ["_at", "id"], 8, "place").select("doc", "id", "place")
    tf = member.join(risks, "cats").select("doc", "name", "tf").unionByName(incs.join(of(incidents, "risks"), "id").select("doc", "name", F.lit(1).cast("long").alias("tf")))
    tf = tf.groupBy("doc", F.col("name").alias("category")).agg(F.sum("tf").alias("tf"))
    df = of(requirements, "risks").unionByName(of(incidents, "risks")).groupBy(F.col("name").alias("category")).agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("total"))
    idf = df.crossJoin(F.broadcast(n)).select("category", smoothed_idf(F.col("df"), F.col("total")).alias("idf"))
    risk = two_pool_rank(tf.join(idf, "category"))
    mits = member.join(measures, "cats").select("doc", F.col("name").alias("category")).distinct()

    def part(name: str, rows: DataFrame, doc: str = "long") -> DataFrame:
        kinds = {"doc": doc, "category": "string", "id": "long", "place": "int", "tf": "long", "score": "double"}
        return rows.select(F.lit(name).alias("part"), *((F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))

    # Each set's rows are one row of a list, so that the join with documents makes none but the result's.
    own = part("incident", incs, "array<string>").unionByName(part("risk", risk, "array<string>")).unionByName(part("mitigation", mits, "array<string>"))
    rest = [c for c in own.columns if c != "doc"]
    own = saved(own.groupBy(F.col("doc").alias("categories")).agg(F.collect_list(F.struct(*rest)).alias("rows")), "lists")
    own = cats.join(own, "categories").select("doc", F.inline("rows")).select("part", "doc", *rest[1:])
    return part("category", found).unionByName(part("requirement", reqs)).unionByName(own)
