"""Rules kept as tables: features of texts, findings, profiles, consistency and data-quality checks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BANDS, case_by_thresholds, negated_before
from ..sources.shared import pieces, saved
from .graph import evidence_tier, same_keys
from .setmetrics import set_prf

DEFAULT_PRIORITY, DEFAULT_SEVERITY = 99, "Violation"


def extract_features(docs: DataFrame, patterns: Sequence[tuple[str, str, bool]], negations: Sequence[str] = (), doc: str = "doc_id", text: str = "text", strict: bool = False) -> DataFrame:
    """(doc, features): of (pattern, feature, is_safeguard) the features whose pattern the lowered text matches. With
    negations, a safeguard is skipped where a negation stands before its first match. Patterns ignore case; strict keeps
    them as written, so upper-case ones never match lowered text."""
    low = F.lower(text)

    def mark(pattern: str, feature: str, safeguard: bool) -> Column:
        p = pattern if strict else f"(?i){pattern}"
        hit = low.rlike(p)
        if safeguard and negations:
            hit = hit & ~negated_before(low, p, negations)
        return F.when(hit, F.lit(feature))

    return docs.select(F.col(doc).alias("doc"), F.array_sort(F.array_distinct(F.array_compact(F.array(*(mark(*p) for p in patterns))))).alias("features"))


def negation_guard(text: Column, pattern: str, negations: Sequence[str], window: int = 40) -> Column:
    return ~negated_before(text, pattern, negations, window)


#: Up to so many rules each document is held against each; beyond that rules are found by an index. Entries of the index,
#: conditions or rules that are broadcast, a few hundred bytes each.
FEW_RULES, BROADCAST_ENTRIES = 64, 100_000
#: Documents whose features are looked at together, at most, and bytes of these features; cells of their table of features,
#: which takes fewer documents (256 at least) where conditions name many features; documents sent on at once.
TOGETHER, TOGETHER_BYTES, CELLS, SENT = 32_768, 16_000_000, 16_000_000, 500_000


def apply_rules(features: DataFrame, rules: DataFrame, few: int = FEW_RULES, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """(doc, rule_id, dimension, priority, severity, message): rules one of whose triggers any_of (if any are given) and
    all of whose all_of are present, and none of none_of. A few rules go to every task. Many are matched by their distinct
    conditions: up to `most` by `Conditions`, which gives each condition beside a list of documents, more by `candidates`.
    Rules, up to `most` of them broadcast, are joined only to what matches. Lists become rows after that, so that findings of
    one rule follow each other and the same documents come again for the next, which files of columns store in little."""
    fires = (F.size("any_of") == 0) | F.arrays_overlap("features", "any_of")
    fires = fires & (F.size(F.array_except("all_of", "features")) == 0) & ~F.arrays_overlap("features", "none_of")
    if rules.limit(few + 1).count() <= few:
        rows = features.crossJoin(F.broadcast(rules)).where(fires)
    else:
        lists = ["any_of", "all_of", "none_of"]
        own = saved(rules.withColumns({c: F.array_sort(F.array_distinct(c)) for c in lists}), "own")
        conditions = saved(own.select(*lists).distinct().withColumn("_condition", F.monotonically_increasing_id()), "conditions")
        own = saved(own.alias("v").join(conditions.alias("s"), same_keys("v", "s", lists)).drop(*lists), "numbered")
        own = F.broadcast(own) if own.count() <= most else own
        if conditions.count() <= most:
            rows = Conditions(conditions).met(features).join(own, "_condition").withColumn("doc", F.explode("docs"))
        else:
            rows = candidates(features, conditions, most).where(fires).select("doc", "_condition").join(own, "_condition")
    return rows.select("doc", "rule_id", "dimension", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"), F.coalesce("severity", F.lit(DEFAULT_SEVERITY)).alias("severity"), "message")


class Conditions:
    """Distinct conditions (any_of, all_of, none_of, _condition), held against many documents at once: each feature of a batch
    is a column of who has it, and a condition's documents come from those it names. A condition is tried if the batch has
    the one of its all_of that the fewest conditions name, or one of its any_of. Nulls are as in Spark's functions on arrays:
    a null list never fires, all_of may ask for a null, and beside a null none_of is not known to be absent."""

    def __init__(self, conditions: DataFrame) -> None:
        lists = ["any_of", "all_of", "none_of"]
        rows = conditions.where(" and ".join(f"{c} is not null" for c in lists)).select("_condition", *lists).collect()
        number: dict[str | None, int] = {None: -1}
        self.lists = [(r["_condition"], *([number.setdefault(x, len(number) - 1) for x in r[c]] for c in lists)) for r in rows]
        self.names = [x for x in number if x is not None]
        named = Counter(f for _, _, all_of, _ in self.lists for f in all_of)
        self.under: dict[int, list[int]] = {}
        self.free: list[int] = []
        for i, (_, any_of, all_of, _) in enumerate(self.lists):
            for f in [min(all_of, key=named.__getitem__)] if all_of else any_of:
                self.under.setdefault(f, []).append(i)
            if not all_of and not any_of:
                self.free.append(i)

    def met(self, features: DataFrame) -> DataFrame:
        """(_condition, docs): for each batch of documents and each condition that some of them meet, these documents, in
        one list or two."""
        rows = max(256, min(TOGETHER, CELLS // max(1, len(self.names))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in gathered(batches, rows, TOGETHER_BYTES):
                of, docs, n = [], [], 0
                for condition, at in self.fitting(b.column("features")):
                    # Columns pack values by eights: what comes again looks the same if it has whole ones.
                    whole = len(at) // 8 * 8
                    own = [x for x in (at[:whole], at[whole:]) if len(x)]
                    of += [condition] * len(own)
                    docs += own
                    n += len(at)
                    if n >= SENT:
                        yield listed(of, docs, b.column("doc"))
                        of, docs, n = [], [], 0
                if of:
                    yield listed(of, docs, b.column("doc"))

        own = features.select("doc", "features")
        return own.mapInArrow(run, f"_condition long, docs array<{own.schema['doc'].dataType.simpleString()}>")

    def fitting(self, features: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        """Conditions with the places, ascending, of the lists of features that meet them."""
        sizes = pc.fill_null(pc.list_value_length(features), 0).to_numpy()
        values, row = pc.list_flatten(features), np.repeat(np.arange(len(sizes)), sizes)
        found = pc.fill_null(pc.index_in(values, pa.array(self.names, values.type)), -1).to_numpy()
        seen, at = np.unique(found[found >= 0], return_inverse=True)
        table = np.zeros((len(seen) + 1, len(sizes)), bool)
        table[at, row[found >= 0]] = True
        table[-1, row[values.is_null().to_numpy(zero_copy_only=False)]] = True
        has = dict(zip([*seen.tolist(), -1], table))
        given = features.is_valid().to_numpy(zero_copy_only=False)
        without: dict[tuple[int, ...], np.ndarray] = {}
        for i in sorted({*self.free, *(i for f in has for i in self.under.get(f, ()))}):
            condition, any_of, all_of, none_of = self.lists[i]
            some = [has[f] for f in any_of if f >= 0 and f in has]
            if any_of and not some or any(f not in has for f in all_of):
                continue
            if (none := tuple(none_of)) not in without:
                bad = [has[f] for f in none if f in has] + [has[-1]] * bool(none) + [sizes > 0] * (-1 in none)
                without[none] = given & ~np.logical_or.reduce(bad) if bad else given
            fit = without[none]
            for f in all_of:
                fit = fit & has[f]
            if some:
                fit = fit & (np.logical_or.reduce(some) if len(some) > 1 else some[0])
            if len(places := np.flatnonzero(fit)):
                yield condition, places


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of that many at most, or of about that many bytes if they are reached first."""
    held: list[pa.RecordBatch] = []
    n = filled = 0
    for b in pieces(batches, 256):
        if held and (n + len(b) > rows or filled >= size):
            yield joined(held)
            held, n, filled = [], 0, 0
        held.append(b)
        n, filled = n + len(b), filled + b.nbytes
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(c) for b in held]) for c in held[0].schema.names], names=held[0].schema.names)


def listed(of: list[int], places: list[np.ndarray], docs: pa.Array) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, places)]).astype("int32")
    return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), docs.take(pa.array(np.concatenate(places))))], names=["_condition", "docs"])


def candidates(features: DataFrame, rules: DataFrame, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """Documents beside the rules that they may meet, each pair once: an index names each rule under the one of its all_of
    that the fewest documents have, or, if it has none, under each of its any_of. So pairs are in proportion to the
    documents that have a rule's rarest feature. Rules without a positive condition meet every document, as they may
    fire on any. The features are written once. Up to `most` entries of the index are broadcast; beyond that documents and
    rules are joined by feature."""
    features = saved(features.select("doc", F.array_distinct("features").alias("features")), "features")
    numbered = saved(rules.withColumn("_rule", F.monotonically_increasing_id()), "rules")
    each = features.select(F.explode("features").alias("feature"))
    frequency = each.groupBy("feature").agg(F.count(F.lit(1)).alias("docs"))
    needed = numbered.where(F.size("all_of") > 0).select("_rule", F.explode("all_of").alias("feature"))
    rarest = needed.join(frequency, "feature", "left").groupBy("_rule").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "feature"))["feature"].alias("feature"))
    any_ = numbered.where((F.size("all_of") == 0) & (F.size("any_of") > 0)).select("_rule", F.explode(F.array_distinct("any_of")).alias("feature"))
    entries = saved(rarest.unionByName(any_).join(numbered, "_rule").withColumnRenamed("feature", "_feature"), "index")
    n = entries.count()
    free = numbered.where((F.size("all_of") == 0) & (F.size("any_of") == 0))
    # Of the any_of of a rule a document may have several: the first of them in its list counts.
    first = F.array_intersect("features", "any_of")
    found = features.withColumn("_f", F.explode("features")).join(F.broadcast(entries) if n <= most else entries, F.col("_f") == F.col("_feature"))
    found = found.where((F.size("all_of") > 0) | (F.col("_f") == F.get(first, F.lit(0)))).drop("_f", "_feature")
    out = found.select("doc", "features", *rules.columns)
    if free.limit(1).count():
        out = out.unionByName(features.crossJoin(F.broadcast(free)).select("doc", "features", *rules.columns))
    return out


def apply_compound_rules(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of rules with all_of, one row each, with `dimensions`: the rule's list of contributing ones."""
    found = apply_rules(features, rules.where(F.size("all_of") > 0))
    return found.join(F.broadcast(rules.select("rule_id", F.col("compound").alias("dimensions"))), "rule_id").select("doc", "rule_id", "dimensions", "priority", "severity", "message")


def profile(findings: DataFrame) -> DataFrame:
    """(doc, dimension, findings): structs (priority, rule_id, severity, message) by priority."""
    return findings.groupBy("doc", "dimension").agg(F.array_sort(F.collect_list(F.struct("priority", "rule_id", "severity", "message"))).alias("findings"))


def profile_overlay(rules: DataFrame, overlay: DataFrame) -> DataFrame:
    """Rules with the priority and severity that the profile (rule_id, priority, severity) gives."""
    o = overlay.select("rule_id", F.col("priority").alias("_p"), F.col("severity").alias("_s"))
    out = rules.join(F.broadcast(o), "rule_id", "left").withColumns({"priority": F.coalesce("_p", "priority"), "severity": F.coalesce("_s", "severity")})
    return out.select(*rules.columns)


def band(docs: DataFrame, findings: DataFrame, mode: str = "dimensions", cuts=BANDS) -> DataFrame:
    """(doc, band) by the number of distinct dimensions, or of findings (mode "findings"); documents without any count 0."""
    n = F.count_distinct("dimension") if mode == "dimensions" else F.count(F.lit(1))
    per = findings.groupBy("doc").agg(n.alias("n"))
    return docs.select("doc").join(per, "doc", "left").select("doc", case_by_thresholds(F.coalesce("n", F.lit(0)), cuts, "Low").alias("band"))


def score_rules(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc, precision, recall) of flagged dimensions against expected (doc, tags): nothing flagged has precision 1 if
    nothing was expected, else 0."""
    got = findings.groupBy("doc").agg(F.collect_set("dimension").alias("pred"))
    rows = expected.join(got, "doc", "left").withColumn("pred", F.coalesce("pred", F.array().cast("array<string>")))
    p, r, _ = set_prf(F.col("pred"), F.col("tags"), "flags")
    return rows.select("doc", p.alias("precision"), r.alias("recall"))


def compare_extractors(features_a: DataFrame, features_b: DataFrame, rules: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc, p_a, r_a, p_b, r_b); a document that an extractor lacks has nulls there, which means skip."""
    out = expected.select("doc")
    for name, f in (("a", features_a), ("b", features_b)):
        own = score_rules(apply_rules(f, rules), expected.join(f.select("doc"), "doc", "left_semi"))
        out = out.join(own.select("doc", F.col("precision").alias(f"p_{name}"), F.col("recall").alias(f"r_{name}")), "doc", "left")
    return out


def consistency_check(items: DataFrame, lists: DataFrame) -> DataFrame:
    """(item, risk, has_requirement, has_mitigation, category_match): of items (item, risks, requirements, mitigations
    (known ones), free_mitigations (a count)), one row a risk; the item's lists count for each of its risks. lists:
    (category, mitigations). A risk without category passes the match; it is null there."""
    rows = items.select("*", F.explode("risks").alias("risk"))
    rows = rows.join(lists.select(F.col("category").alias("risk"), F.col("mitigations").alias("_list")), "risk", "left")
    match = F.when(F.col("risk").isNotNull() & (F.col("risk") != ""), F.coalesce(F.arrays_overlap("mitigations", "_list"), F.lit(False)))
    return rows.select("item", "risk", (F.size("requirements") > 0).alias("has_requirement"), ((F.size("mitigations") > 0) | (F.col("free_mitigations") > 0)).alias("has_mitigation"), match.alias("category_match"))


def consistency_rates(checked: DataFrame, config: str) -> DataFrame:
    """(config, n_risks, req, mit, match): shares over risks; the last only over risks with a category."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return checked.groupBy(config).agg(F.count(F.lit(1)).alias("n_risks"), share("has_requirement").alias("req"), share("has_mitigation").alias("mit"), share("category_match").alias("match"))


def evidence_priority(edges: DataFrame, right: str, item: str) -> DataFrame:
    counts = edges.groupBy(right).agg(F.count_distinct(item).alias("n"))
    return evidence_tier(counts).withColumnRenamed("tier", "priority")


# Data quality: each check gives the violating rows' keys.


def count_bounds(subjects: DataFrame, edges: DataFrame, key: str, low: int = 0, high: int | None = None) -> DataFrame:
    n = edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = subjects.select(key).join(n, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return rows.where((F.col("_n") < low) | (F.col("_n") > high if high is not None else F.lit(False))).select(key)


def not_matching(rows: DataFrame, key: str, col: str, pattern: str) -> DataFrame:
    return rows.where(~F.coalesce(F.col(col).cast("string").rlike(pattern), F.lit(False))).select(key)


def not_in(rows: DataFrame, key: str, col: str, values: Sequence) -> DataFrame:
    return rows.where(~F.coalesce(F.col(col).isin(*values), F.lit(False))).select(key)


def dangling(rows: DataFrame, key: str, col: str, targets: DataFrame, target: str) -> DataFrame:
    return rows.where(F.col(col).isNotNull()).join(targets.select(F.col(target).alias(col)).distinct(), col, "left_anti").select(key)


def implies(rows: DataFrame, key: str, if_: Column, then: Column) -> DataFrame:
    return rows.where(if_ & ~F.coalesce(then, F.lit(False))).select(key)


def orphans(rows: DataFrame, key: str, users: DataFrame, used: str) -> DataFrame:
    return rows.select(key).join(users.select(F.col(used).alias(key)).distinct(), key, "left_anti")


def not_unique(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(key)


def quality_report(violations: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, violations, passed) of named tables of violating keys, all rules in one result."""
    out = None
    for rule, rows in violations.items():
        own = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations", (F.col("violations") == 0).alias("passed"))
        out = own if out is None else out.unionByName(own)
    return out


def corpus_checks(docs: DataFrame, id_col: str, required: Sequence[str], vocab: Mapping[str, Sequence], ranges: Mapping[str, tuple[float, float]], label: str, cap: float, n: int | None = None) -> DataFrame:
    """(check, violations, passed): count, unique ids, nulls, vocabularies, ranges, greatest share of a label."""
    found = {f"null_{c}": docs.where(F.col(c).isNull()).select(id_col) for c in required}
    found |= {f"vocab_{c}": not_in(docs.where(F.col(c).isNotNull()), id_col, c, v) for c, v in vocab.items()}
    found |= {f"range_{c}": docs.where((F.col(c) < a) | (F.col(c) > b)).select(id_col) for c, (a, b) in ranges.items()}
    found["unique"] = not_unique(docs, id_col)
    found["share"] = label_share(docs, label, cap).where("not ok").select(F.col(label).alias(id_col))
    out = quality_report(found).withColumnRenamed("rule", "check")
    if n is not None:
        size = docs.agg((F.count(F.lit(1)) != n).cast("long").alias("violations"))
        out = out.unionByName(size.select(F.lit("count").alias("check"), "violations", (F.col("violations") == 0).alias("passed")))
    return out


def label_share(docs: DataFrame, label: str, cap: float) -> DataFrame:
    """(label, n, share, ok)."""
    n = docs.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))  # one row a label
    return n.withColumn("ok", F.col("share") <= cap)


def competency_suite(named: Mapping[str, DataFrame], criteria: Mapping[str, tuple]) -> DataFrame:
    """(id, passed, detail): each named table against ("nonzero",), ("rows", n) or ("keys", column, set)."""
    out = None
    for name, df in named.items():
        kind, *arg = criteria[name]
        if kind == "keys":
            own = df.agg(F.array_sort(F.collect_set(F.col(arg[0]).cast("string"))).alias("k"))
            own = own.select(F.lit(name).alias("id"), (F.col("k") == F.array(*map(F.lit, sorted(map(str, arg[1]))))).alias("passed"), F.array_join("k", ",").alias("detail"))
        else:
            own = df.agg(F.count(F.lit(1)).alias("n"))
            own = own.select(F.lit(name).alias("id"), (F.col("n") > 0 if kind == "nonzero" else F.col("n") == arg[0]).alias("passed"), F.col("n").cast("string").alias("detail"))
        out = own if out is None else out.unionByName(own)
    return out
