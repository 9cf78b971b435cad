"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Defined cases: a null or blank text has no words, all counts 0, and fails the length rule; ratios over nothing are 0;
repeated rows are judged alike, each on its own; other columns of the input pass through untouched, but `measure` and
`judge` replace columns that have the names of theirs (metrics, base_failed, broken, kept); `keep` returns every column
as it came. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words


class Rule(NamedTuple):
    """A text passes if low <= metric <= high; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "con del el es los las no para por se su una y"
).split()

#: The production table. Lengths in words, ratios over words or over lines that hold a word.
RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("too_long", "n_words", high=1_000_000),
    Rule("word_length", "mean_word_length", low=2, high=15),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("shouting", "upper_ratio", high=0.5),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.5),
)


#: The metrics, in the order in which `measure` computes them.
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_length", "symbol_ratio", "upper_ratio", "stop_word_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measure(docs: DataFrame, text: str = "text", into: str = "metrics", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds struct `into` with every metric of each whole text. No shuffle, no user function.

    Repeated words: texts whose 3-word windows have as many distinct hashes as windows repeat none. In the others the
    windows are sorted with their places inside the row, so equal ones are neighbours; the words that a window with an
    equal neighbour covers are counted once.
    """
    docs = docs.drop(into)
    # Plain columns, each read more than once by the next step, so that Spark keeps the steps apart: an expression that
    # it inlined into a lambda would be computed again for every element.
    t, w, lines, g = names = [f"__{into}_{k}" for k in "twlg"]
    hashes = f"__{into}_h"
    step = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({w: words(F.col(t)), lines: F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    gram = lambda x, i: F.struct(F.concat_ws(" ", x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)).alias("g"), i.alias("i"))
    windows = F.greatest(F.size(w) - 2, F.lit(0))
    step = step.withColumn(hashes, F.slice(F.transform(F.col(w), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))), F.lit(1), windows))
    some = F.array_sort(F.slice(F.transform(F.col(w), gram), F.lit(1), windows))
    step = step.withColumn(g, F.when(F.size(F.array_distinct(F.col(hashes))) < F.size(hashes), some))
    t, w, lines, g = map(F.col, names)
    names.append(hashes)
    repeated = F.filter(g, lambda x, i: (x["g"] == F.get(g, i + 1)["g"]) | F.coalesce(x["g"] == F.get(g, i - 1)["g"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    n, n_lines = F.size(w).cast("long"), F.size(lines).cast("long")
    chars = F.length(F.array_join(w, "")).cast("long")
    symbols = (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long")
    upper = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]+", ""))
    dup = n_lines - F.size(F.array_distinct(lines))
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    # Flat first: fields of a struct would be computed again by each rule that reads them. The row number's share is always
    # 0; it keeps Spark from moving a filter on the verdict below this step, which would write all of it out in the filter.
    n = n + F.least(F.monotonically_increasing_id(), F.lit(0))
    metrics = [
        n, chars, symbols, dup.cast("long"), F.when(g.isNull(), 0).otherwise(F.size(covered)).cast("long"),
        _ratio(chars, n), _ratio(symbols, n), _ratio(upper, letters),
        _ratio(F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*stop_words))), n),
        _ratio(dup, n_lines),
        _ratio(count(lines, lambda x: F.ltrim(x).rlike("^[-*•]")), n_lines),
        _ratio(count(lines, lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$")), n_lines),
    ]
    flat = {f"__{into}_{i}": c for i, c in enumerate(metrics)}
    step = step.select(*docs.columns, *(c.alias(k) for k, c in flat.items()))
    return step.select(*docs.columns, F.struct(*(F.col(k).alias(n) for k, n in zip(flat, METRICS, strict=True))).alias(into))


def compiled(rules: Sequence[Rule] = RULES, metrics: str = "metrics") -> Column:
    """The names of the rules that a row breaks, in the table's order, as one array expression."""
    broken = []
    for r in rules:
        m = F.col(f"{metrics}.{r.metric}")
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Adds metrics, base_failed, broken (names of broken rules) and kept."""
    m = measure(docs.drop("base_failed", "broken", "kept"), text)
    base = (F.col("metrics.n_words") < 50) | (100 * F.col("metrics.n_repeat_words") > 50 * F.col("metrics.n_words"))
    m = m.withColumns({"base_failed": base, "broken": compiled(rules)})
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass, with the columns that came."""
    own = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))  # no name can clash
    kept = judge(own, rules, f"__{docs.columns.index('text')}").where("kept")
    return kept.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))
