"""Sources and sinks: graphs, documents, annotations; ordered overlays; guarded writes; work plans."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import pieces

#: One statement of N-Triples: subject, predicate, object as IRI, blank node or literal with language or datatype.
_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'


def parse_ntriples(lines: DataFrame, line: str = "value") -> DataFrame:
    """Triples (s, p, o, o_kind, o_datatype, o_lang) of lines of text; blank lines, comments and others are dropped."""
    part = lambda i: F.regexp_extract(F.col(line), _TRIPLE, i)
    some = lambda i: F.nullif(part(i), F.lit(""))
    return lines.where(F.col(line).rlike(_TRIPLE)).select(
        F.regexp_replace(part(1), "[<>]", "").alias("s"), part(2).alias("p"), F.coalesce(some(3), some(4), part(5)).alias("o"),
        F.when(some(3).isNotNull(), "uri").when(some(4).isNotNull(), "bnode").otherwise("literal").alias("o_kind"), some(7).alias("o_datatype"), some(6).alias("o_lang"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def read_assessments(spark: SparkSession, path: str, schema: str, skip: str = "FAILED|ablation", name_glob: str = "P*_full.json") -> DataFrame:
    """JSON documents, one a file, without files whose name holds a word of `skip`, broken files, documents with an error
    and documents whose assessment names no risks. Adds `file`."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", name_glob)
    docs = raw.schema(f"{schema}, _corrupt string").json(path).withColumn("file", F.col("_metadata.file_name"))
    docs = docs.where(F.col("_corrupt").isNull() & ~F.col("file").rlike(skip)).drop("_corrupt")
    inner = docs.schema["assessment"].dataType.fieldNames() if "assessment" in docs.columns else []
    for k in ("error", "parse_error"):
        if k in inner:
            docs = docs.where(F.col(f"assessment.{k}").isNull())
    return docs.where(F.col("assessment.identified_risks").isNotNull()) if "identified_risks" in inner else docs


def file_key(docs: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Adds `key`, the id in the file's name by the first pattern that fits it, and `prio`, that pattern's place."""
    hits = [F.when(F.col("file").rlike(p), F.struct(F.regexp_extract("file", p, 1).alias("key"), F.lit(i).alias("prio"))) for i, p in enumerate(patterns)]
    return docs.withColumn("_hit", F.coalesce(*hits)).where("_hit is not null").select(*docs.columns, "_hit.key", "_hit.prio")


def read_annotations(spark: SparkSession, path: str, least_rows: int, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return at_least(rows, least_rows)


def at_least(rows: DataFrame, least_rows: int) -> DataFrame:
    n = rows.count()
    if n < least_rows:
        raise ValueError(f"{n} rows, at least {least_rows} are needed")
    return rows


def overlay_sources(sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """For each key the row of the first source that has it. Each source has a key once."""
    put = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), put)
    first = F.row_number().over(W.partitionBy(*key).orderBy("_prio"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_prio")


def explode_ratings(docs: DataFrame, item: str, ratings: str, value_type: str) -> DataFrame:
    """(item, rater, rating fields) of a JSON map rater -> rating in column `ratings`."""
    parsed = docs.select(F.col(item).alias("item"), F.explode(F.from_json(ratings, f"map<string,{value_type}>")).alias("rater", "rating"))
    return parsed.select("item", "rater", "rating.*") if value_type.startswith("struct") else parsed


def read_template(spark: SparkSession, template: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """(authority, pos, pool_key, label) of ordered check lists."""
    rows = [(a, i, k, label) for a, items in template.items() for i, (k, label) in enumerate(items)]
    return spark.createDataFrame(rows, "authority string, pos int, pool_key string, label string")


#: Characters of a batch of sections, about.
SENT = 4_000_000


def sections_batch(b: pa.RecordBatch, rows: list, at: list, heads: list, lines: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(heads, pa.string()), pa.array(lines, pa.string())], names=["doc", "pos", "section", "line"])


def scan_sections(docs: DataFrame, doc: str, text: str, mark: str = "## ") -> DataFrame:
    """(doc, pos, section, line): each line with the last heading at or above it. One walk over a text's lines inside its
    row, so nothing is shuffled and a stream can be read as well. A null text has no lines."""
    own = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, at, heads, lines, size = [], [], [], [], 0
            for i, t in enumerate(b.column("t")):
                head, t = None, t.as_py()
                for pos, line in enumerate([] if t is None else t.split("\n")):
                    if line.startswith(mark):
                        head = line[len(mark) :]
                    rows.append(i)
                    at.append(pos)
                    heads.append(head)
                    lines.append(line)
                    size += len(line) + len(head or "") + 100
                    if size > SENT:  # a heading is repeated at each of its lines
                        yield sections_batch(b, rows, at, heads, lines)
                        rows, at, heads, lines, size = [], [], [], [], 0
            yield sections_batch(b, rows, at, heads, lines)

    return own.mapInArrow(run, f"doc {own.schema['doc'].dataType.simpleString()}, pos int, section string, line string")


def carry_forward(df: DataFrame, col: str, part: str, order: str) -> DataFrame:
    """The column's last value that is not null, at or before each row of its part."""
    return df.withColumn(col, F.last(col, True).over(W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null."""
    fix = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    finite(df).write.mode("overwrite").format(form).save(path)


def merge_protect(existing: DataFrame, new: DataFrame, key: Sequence[str], valid: Column, version: str) -> tuple[DataFrame, DataFrame]:
    """(table, failures): each key's latest valid row, or its latest row if none is valid; the rows that are not valid."""
    both = existing.unionByName(new).withColumn("_ok", F.coalesce(valid, F.lit(False)))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_ok"), F.desc(version)))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n", "_ok"), both.where("not _ok").drop("_ok")


def pending(plan: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    return plan.join(done.select(*key).distinct(), list(key), "left_anti")


def work_plan(*dims: DataFrame) -> DataFrame:
    """All combinations of small dimension tables."""
    return functools.reduce(lambda a, b: a.crossJoin(b), dims)


def blinded_export(docs: DataFrame, id_col: str, text: str, blanks: Sequence[str]) -> DataFrame:
    return docs.select(id_col, text, *(F.lit(None).cast("string").alias(b) for b in blanks))


def snapshot(subjects: DataFrame, key: str, many: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Subjects with one sorted array of distinct values for each named table (key, value); every table is grouped
    before it is joined, so rows never multiply. Subjects without values get empty arrays."""
    out = subjects
    for name, (table, value) in many.items():
        own = table.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
        kind = own.schema[name].dataType
        out = out.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def skips(skipped: DataFrame, by: Sequence[str]) -> DataFrame:
    return skipped.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def acceptance_gate(done: DataFrame, skipped: DataFrame, most_skips: int, least_rows: int) -> DataFrame:
    """One row: done, skipped and whether the run passes."""
    a, b = done.agg(F.count(F.lit(1)).alias("done")), skipped.agg(F.count(F.lit(1)).alias("skipped"))
    return a.crossJoin(b).withColumn("passed", (F.col("skipped") < most_skips) & (F.col("done") >= least_rows))


def ids_from_text(ids: Column, text: Column, pattern: str) -> Column:
    """The ids, or where they are missing those that the pattern finds in the text, each once."""
    return F.coalesce(ids, F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))
