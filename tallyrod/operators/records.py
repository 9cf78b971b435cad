"""Records and vocabularies: validation, repair, defaults, inline values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def validate_record(rows: DataFrame, label: str, labels: Sequence[str], tags: str, vocab: Sequence[str], number: str, low: int = 1, high: int = 5) -> DataFrame:
    """Adds `error` (null for a valid row): the label must be one of `labels`, tags an array, the number an integer from low
    to high. Tags outside the vocabulary are dropped, the number is cast."""
    n = F.col(number).try_cast("int")
    error = (
        F.when(~F.coalesce(F.col(label).isin(*labels), F.lit(False)), "label").when(F.col(tags).isNull(), "tags").when(n.isNull(), "number").when((n < low) | (n > high), "range")
    )
    known = F.filter(tags, lambda t: t.isin(*vocab))
    return rows.withColumns({"error": error, tags: known, number: n})


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the error, quarantined rows with it)."""
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def fuzzy_vocab(tags: DataFrame, vocab: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, entry): each tag's own entry, or the first entry of the vocabulary (pos, entry, stem) whose stem the tag holds
    or which holds the tag; null if none fits. Distinct tags meet the vocabulary, which is a short list."""
    own = tags.select(F.col(tag).alias("tag")).where("tag is not null").distinct()
    v = vocab.select("pos", "entry", "stem")
    fits = (F.col("tag") == F.col("entry")) | F.col("tag").contains(F.col("stem")) | F.col("entry").contains(F.col("tag"))
    hits = own.join(F.broadcast(v), fits, "left")
    first = hits.groupBy("tag").agg(F.min(F.when(F.col("entry").isNotNull(), F.struct((F.col("tag") != F.col("entry")).alias("other"), "pos", "entry"))).alias("x"))
    return first.select("tag", F.col("x.entry").alias("entry"))


def inline_values(spark: SparkSession, column: str, values: Sequence) -> DataFrame:
    """A table of one column from a list in the query; a join with it takes the place of a long IN."""
    return spark.createDataFrame([(v,) for v in values], [column])


def tab_filter(rows: DataFrame, column: str, choice: str | None) -> DataFrame:
    """Rows of the chosen tab; None shows all."""
    return rows if choice is None else rows.where(F.col(column) == choice)


def backfill_defaults(docs: DataFrame, key: str, defaults: Mapping[str, Column], twins: Mapping[str, str], lookup: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(filled, missing): nulls take their default, an empty list is copied from its twin, `lookup` adds its fields by key;
    missing holds the rows that still lack a required field."""
    out = docs.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})
    out = out.withColumns({c: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.col(twin)).otherwise(F.col(c)) for c, twin in twins.items()}).join(lookup, key, "left")
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull()
    return out, out.where(lacks)


def reject_missing(filled: DataFrame, missing: DataFrame) -> DataFrame:
    n = missing.count()
    if n:
        raise ValueError(f"{n} rows lack a required field")
    return filled

