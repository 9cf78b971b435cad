"""Documents made of findings: grouped lines, field pools, context blocks, completeness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_limit, truncate_text
from .graph import ranked


def unfilled_fields(sections: DataFrame, marker: str) -> DataFrame:
    """(authority, field, n): lines that hold the marker, by authority and section, most first."""
    return sections.where(F.col("line").contains(marker)).groupBy("authority", F.col("section").alias("field")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "authority", "field")


def completeness(pools: DataFrame, template: DataFrame) -> DataFrame:
    """(authority, doc, filled, total) of (doc, pool map<string,string>): template fields that the pool fills. The template is
    a short list and goes to every task."""
    rows = pools.crossJoin(F.broadcast(template))
    filled = F.coalesce(F.length(F.trim(F.try_element_at("pool", F.col("pool_key")))) > 0, F.lit(False))
    return rows.groupBy("authority", "doc").agg(F.sum(filled.cast("long")).alias("filled"), F.count(F.lit(1)).alias("total"))


def mean_completeness(per_doc: DataFrame) -> DataFrame:
    return per_doc.groupBy("authority").agg(F.avg(F.col("filled") / F.col("total")).alias("mean"))


def group_lines(risks: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc, text, sources): the findings (doc, category, risk) in lines by category; sources (doc, category, id) or a note."""
    lines = risks.groupBy("doc", "category").agg(F.concat(F.col("category"), F.lit(": "), F.array_join(F.array_sort(F.collect_list("risk")), "; ")).alias("line"))
    text = lines.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    own = sources.join(risks.select("doc", "category").distinct(), ["doc", "category"], "left_semi").groupBy("doc").agg(F.array_sort(F.collect_set("id")).alias("sources"))
    return text.join(own, "doc", "left").withColumn("sources", F.coalesce("sources", F.array(F.lit("untraced"))))


def build_pool(docs: DataFrame, doc: str, fields: Mapping[str, tuple[Column, Column]], fallbacks: Mapping[str, str] | None = None) -> DataFrame:
    """(doc, pool map<key, struct<text, sources>>) of named (text, sources) columns; a field without text takes the text of
    its fallback."""
    texts = {k: t for k, (t, _) in fields.items()}
    full = {k: F.coalesce(F.nullif(t, F.lit("")), texts[fallbacks[k]]) if k in (fallbacks or {}) else t for k, t in texts.items()}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.struct(full[k].alias("text"), s.alias("sources")).alias("value")) for k, (_, s) in fields.items()))
    return docs.select(F.col(doc).alias("doc"), F.map_from_entries(F.filter(entries, lambda e: F.length(e["value"]["text"]) > 0)).alias("pool"))


def context_block(reqs: DataFrame, others: Mapping[str, DataFrame], n: int = 25) -> DataFrame:
    """(doc, context): the first n requirements (doc, id, text, mandatory), mandatory first, texts cut to their limit, then
    a line for each other table (doc, value)."""
    top = ranked(reqs, ["doc"], [F.desc("mandatory"), "id"], n)
    count = top.groupBy("doc").agg(F.count(F.lit(1)).alias("_n"))
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.coalesce(truncate_text(F.col("text"), text_limit(F.col("_n"))), F.col("text")))
    lines = top.join(count, "doc").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("requirements"))
    out, names = lines, ["requirements"]
    for name, table in others.items():
        own = table.groupBy("doc").agg(F.concat(F.lit(f"{name}: "), F.array_join(F.array_sort(F.collect_set("value")), ", ")).alias(name))
        out, names = out.join(own, "doc", "left"), [*names, name]
    return out.select("doc", F.concat_ws("\n", *names).alias("context"))
