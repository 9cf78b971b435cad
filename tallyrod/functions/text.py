"""Scalar functions over text, ids and labels: each takes columns and gives a column of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids and names


def local_name(iri: Column) -> Column:
    """What follows the last slash, and in that the last number sign."""
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def contains_ci(text: Column, term: str) -> Column:
    return F.lower(text).contains(term.lower())


def id_filter(df: DataFrame, col: str, prefix: str | None = None, part: str | None = None) -> DataFrame:
    """Rows whose id starts with `prefix` and holds `part`; None asks nothing."""
    keep = F.lit(True)
    if prefix is not None:
        keep = keep & F.col(col).startswith(prefix)
    if part is not None:
        keep = keep & F.col(col).contains(part)
    return df.where(keep)


def in_set(col: Column, values: Sequence) -> Column:
    return col.isin(*values)


def non_empty(col: Column) -> Column:
    return col.isNotNull() & (F.length(col) > 0)


#: Spellings of an article's number: the first needs the abbreviation to touch the number, the second lets a blank between.
ARTICLE = {"close": r"(?:Article\s*|Art)(\d+)", "spaced": r"Art(?:icle)?\s*(\d+)"}


def article_no(text: Column, dialect: str = "spaced", pattern: str | None = None) -> Column:
    """The first article number in a text, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern or ARTICLE[dialect], 1), F.lit(""))


def norm_id(text: Column, prefix: str, replaced_by: str = "", strict: bool = True) -> Column:
    """A bare id: without brackets, blanks and (by pattern) its framework's prefix. strict: also in upper case, with the
    prefix's replacement; else the prefix is only dropped."""
    bare = F.regexp_replace(F.trim(text), r"[\[\]()]", "")
    if strict:
        return F.upper(F.regexp_replace(F.regexp_replace(bare, prefix, replaced_by), r"\s+", ""))
    return F.trim(F.regexp_replace(bare, prefix, ""))


def bucket_by_prefix(col: Column, prefixes: Sequence[tuple[str, str]], default: str) -> Column:
    """The bucket of the first prefix in order that the id starts with."""
    out = F.lit(default)
    for prefix, bucket in reversed(prefixes):
        out = F.when(col.startswith(prefix), bucket).otherwise(out)
    return out


def iri_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_\-.:]", "_")


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")


# Labels


def norm_label(raw: Column, labels: Sequence[str], short: Mapping[str, str] | None = None) -> Column:
    """Trimmed, in title case, short forms spelled out; null if it is no label."""
    out = F.initcap(F.trim(raw))
    for a, b in (short or {}).items():
        out = F.when(out == a, b).otherwise(out)
    return F.when(out.isin(*labels), out)


def label_with_fallback(label: Column, severities: Column, labels: Sequence[str] = ("High", "Medium", "Low")) -> Column:
    """The label itself, else the first label that its text holds, else one from the severities: any high, any medium or
    moderate, any at all; null without any."""
    exact = F.when(label.isin(*labels), label)
    held = F.coalesce(*(F.when(contains_ci(label, x), F.lit(x)) for x in labels))
    low = F.transform(severities, lambda s: F.lower(s))
    derived = (
        F.when(F.exists(low, lambda s: s == "high"), labels[0])
        .when(F.exists(low, lambda s: s.isin("medium", "moderate")), labels[1])
        .when(F.size(severities) > 0, labels[2])
    )
    return F.coalesce(exact, held, derived)


def ordinal(label: Column, levels: Sequence[str], start: int = 0) -> Column:
    out = F.lit(None).cast("int")
    for i, x in reversed(list(enumerate(levels))):
        out = F.when(label == x, F.lit(i + start)).otherwise(out)
    return out


def confidence_flag(n_keywords: Column, n_hits: Column, least_keywords: int = 3, least_hits: int = 50) -> Column:
    return F.when((n_keywords < least_keywords) | (n_hits < least_hits), "LOW").otherwise("NORMAL")


def case_by_thresholds(n: Column, cuts: Sequence[tuple[float, str]], default: str) -> Column:
    """The label of the first cut that n reaches; cuts fall."""
    out = F.lit(default)
    for cut, name in reversed(cuts):
        out = F.when(n >= cut, name).otherwise(out)
    return out


#: Counts to bands, and agreement to bands.
BANDS = ((4, "High"), (2, "Medium"))
KAPPA_BANDS = ((0.80, "almost perfect"), (0.60, "substantial"), (0.40, "moderate"), (0.20, "fair"))


def kappa_band(kappa: Column) -> Column:
    return F.when(kappa.isNotNull(), case_by_thresholds(kappa, KAPPA_BANDS, "slight or none"))


def divergence_note(kappa: Column, rho: Column, by: float = 0.15) -> Column:
    """Which of the two is larger where they differ by more than `by`."""
    gap = rho - kappa
    return F.when(gap > by, "order agrees better than labels").when(gap < -by, "labels agree better than order").when(gap.isNotNull(), "consistent")


def first_match(array: Column, matches: Callable[[Column], Column]) -> Column:
    """The first element that matches, null if none does."""
    return F.get(F.filter(array, matches), F.lit(0))


# Counting and cutting


def substring_count(text: Column, part: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def prefix_count(text: Column, stem: str) -> Column:
    """Words that start with the stem."""
    return F.regexp_count(text, F.lit(rf"\b{stem}\w*"))


def word_count(text: Column) -> Column:
    """Words parted by white space, 1 at least."""
    return F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(1))


def tokens(text: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def any_of(text: Column, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))


def negated_before(text: Column, pattern: str, negations: Sequence[str], window: int = 40) -> Column:
    """Whether the `window` characters before the pattern's first match end in a negation word."""
    at = F.regexp_instr(text, F.lit(f"({pattern})"))
    start = F.greatest(at - window, F.lit(1))
    before = F.substring(text, start, F.greatest(at - start, F.lit(0)))
    return (at > 0) & before.rlike(rf"\b(?:{'|'.join(negations)})\b[^.;!?]*$")


def csv_split(text: Column) -> Column:
    """Trimmed parts between commas, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_join(array: Column) -> Column:
    return F.array_join(array, ", ")


def prefix(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def text_limit(n_items: int | Column) -> Column:
    """Characters for each of n items: no limit (null) up to 25, else 3500 shared among them, from 40 to 120."""
    n = n_items if isinstance(n_items, Column) else F.lit(n_items)
    return F.when(n > 25, F.greatest(F.lit(40), F.least(F.lit(120), F.floor(F.lit(3500) / n)))).cast("int")


def truncate_text(text: Column, limit: Column) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, limit)), F.lit("..."))).otherwise(text)


def min_length(text: Column, n: int = 50) -> Column:
    return F.length(F.trim(text)) >= n


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def lookup(table: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(table, key), default)


# Out of noisy text


def json_text(text: Column) -> Column:
    """What a fence marked json holds, if there is one; of that, from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(text, "(?s)```json\\s*(.*?)```", 1)
    return F.nullif(F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)\{.*\}", 0), F.lit(""))


def json_object(text: Column, schema: str) -> Column:
    """A struct of `schema` with _corrupt for text that cannot be parsed."""
    held = json_text(text)
    return F.coalesce(F.from_json(held, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), schema))


def score_in(text: Column, key: str = "score", default: float = 0.5) -> Column:
    """The number after "key": in a text, kept from 0 to 1."""
    return F.coalesce(clamp(F.regexp_extract(text, rf'"{key}"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1).try_cast("double"), 0.0, 1.0), F.lit(default))


def resolve_term(given: Column, text: Column, names: Sequence[tuple[str, str]], hints: Sequence[tuple[str, str]]) -> Column:
    """A term of a taxonomy (id, name): by the given id, letters and digits only; else by its name as whole words in the
    text; else by a hint (part of the text, id). Earlier entries win."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    by_id = [F.when(plain(given) == plain(F.lit(i)), F.lit(i)) for i, _ in names]
    by_name = [F.when(text.rlike(rf"(?i)\b{name}\b"), F.lit(i)) for i, name in names]
    by_hint = [F.when(contains_ci(text, part), F.lit(i)) for part, i in hints]
    return F.coalesce(*by_id, *by_name, *by_hint)


def resolve_category(given: Column, fields: Sequence[Column], names: Sequence[str]) -> Column:
    """The given name if it is one, else the first known name in the fields put together."""
    text = F.concat_ws(" ", *fields)
    return F.coalesce(F.when(given.isin(*names), given), *(F.when(contains_ci(text, x), F.lit(x)) for x in names))


def additive_score(parts: Sequence[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(sum of the points of the conditions that hold, their reasons in order)."""
    score = sum((F.when(c, F.lit(n)).otherwise(0) for c, n, _ in parts), F.lit(0))
    return score, F.array_compact(F.array(*(F.when(c, F.lit(why)) for c, _, why in parts)))


def smoothed_idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def spearman_brown(rho: Column, n: Column, target: Column) -> Column:
    """Reliability projected from n to `target` items."""
    k = target / n
    return k * rho / (1 + (k - 1) * rho)
