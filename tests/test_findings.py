"""Rows in between stay in proportion to the input: each of these made many more before."""

import pyarrow as pa
from pyspark.sql import functions as F

from tallyrod.operators import agreement as A
from tallyrod.operators import graph as G
from tallyrod.operators import keywords as K
from tallyrod.operators import lexicon as L
from tallyrod.operators import rules as R
from tallyrod.operators import setmetrics as S
from tallyrod.plans import retrieval as P
from tallyrod.plans.mirror import RULE_SCHEMA
from tallyrod.sources import tables as X


def most_joined(df):
    """The result, and the rows of the join that gave the most."""
    rows = df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() or "Cartesian" in plan.nodeName() else 0
        kids = plan.children()
        return max([own, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_mitigations_of_repeated_map_and_items(spark):
    items = spark.createDataFrame([(i, ["b", "a"] if i % 2 else ["a", "x"]) for i in range(400)] + [(900, [])], "item long, risks array<string>")
    names = spark.createDataFrame([(c, m) for c, m in (("a", "m1"), ("a", "m2"), ("b", "m2"), ("b", None)) for _ in range(300)], "category string, mitigation string")
    patterns = S.risk_patterns(items)
    rows, most = most_joined(S.mitigation_usage(patterns, names))
    assert sorted(tuple(r) for r in rows) == [("m1", 400), ("m2", 400)]
    assert most <= 10  # items and copies in the map multiply otherwise
    assert [r[0] for r in S.unknown_risks(patterns, names).collect()] == ["x"]
    rows, most = most_joined(S.mitigation_assign(items, names))
    assert {r["item"]: r["mitigations"] for r in rows} == {i: ["m1", "m2"] for i in range(400)} and most <= 2_000


def test_shared_tags_join_only_the_first_items(spark):
    words = {"law": ["license"], "data": ["data"]}
    docs = spark.createDataFrame([(i % 150, ("license data", "license", "data", "none", None)[i % 5]) for i in range(200)], "doc long, text string")
    items = spark.createDataFrame([(i // 2, "license" if i % 4 < 2 else "data and license" if i % 8 < 4 else "data") for i in range(3_000)], "item long, text string")
    rows, most = most_joined(L.keyword_tag_filter(docs, items, words, 7))
    tags = lambda t: {w for w in ("license", "data") if w in (t or "")}
    own, want = {}, set()
    for r in docs.collect():
        own.setdefault(r["doc"], set()).update(tags(r["text"]))
    of = [(r["item"], tags(r["text"])) for r in items.collect()]
    for d, t in own.items():
        want |= {(d, i) for i in sorted({i for i, x in of if x & t})[:7]}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert most <= 7 * 150


def test_ranks_of_one_part_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(G.running_counts, "__defaults__", ("n", 50))
    rows = [("p", (i * 37) % 400 // 2, float((i * i) % 301)) for i in range(900)] + [("q", 1, 2.0), (None, 3, 4.0), (None, 1, 1.0), ("p", 5, None)]
    df = spark.createDataFrame(rows, "part string, x long, y double")
    got = sorted((r["part"] or "", r["y"] is not None, r["y"] or 0.0, r["rank"]) for r in G.average_rank(df, "y", ["part"]).collect())
    want = []
    for p in ("p", "q", None):
        own = sorted((y is not None, y or 0.0) for part, _, y in rows if part == p)
        want += [(p or "", *v, own.index(v) + (own.count(v) + 1) / 2) for v in own]
    assert got == sorted(want)
    slices = G.running_counts(df.where("part = 'p'").groupBy("part", "x").agg(F.count(F.lit(1)).alias("n")), ["part"], "x")
    assert slices.select("part", "x").distinct().count() == slices.count() == 200 and slices.agg(F.max("_to")).first()[0] == 901
    rho = {r["part"]: (r["rho"], r["n"]) for r in A.spearman_rho(df, ["part"]).collect()}
    pandas = df.where("part = 'p' and y is not null").toPandas()
    assert abs(rho["p"][0] - pandas["x"].rank().corr(pandas["y"].rank())) < 1e-12 and rho["p"][1] == 900
    assert rho["q"] == (None, 1) and rho[None] == (1.0, 2)
    assert A.spearman_rho(df.where("part is null"), []).first()["rho"] == 1.0


def test_rules_of_equal_conditions_are_matched_once(spark):
    """Before, each document met each rule that shares its feature."""
    features = spark.createDataFrame([(i, ["a", "b", "x"] if i else ["a", "b"]) for i in range(200)], "doc long, features array<string>")
    rules = [(f"r{i}", "d", None, None, [["a"], ["b", "a", "a"]][i % 2], [], ["x"], [], "m") for i in range(2_000)]
    rows, most = most_joined(R.apply_rules(features, spark.createDataFrame(rules, RULE_SCHEMA)))
    assert sorted((r["doc"], r["rule_id"]) for r in rows) == sorted((0, r[0]) for r in rules)
    assert most <= 2_000


def test_documents_that_meet_a_condition_go_on_as_lists(spark):
    """Before, each document and condition was a row of its own, which was shuffled and met the rules."""
    features = spark.createDataFrame([(i, ["a", "b", "x"] if i % 50 == 0 else ["a", "b"]) for i in range(2_000)], "doc long, features array<string>")
    rules = [(f"r{i}", "d", None, None, [["a"], []][i % 2], [[], ["b"]][i % 2], ["x", f"y{i}"], [], "m") for i in range(100)]
    rows, most = most_joined(R.apply_rules(features, spark.createDataFrame(rules, RULE_SCHEMA)))
    assert sorted((r["doc"], r["rule_id"]) for r in rows) == sorted((i, r[0]) for i in range(2_000) if i % 50 for r in rules)
    assert most <= 100 * 2 * 4  # two lists of each condition in each partition


def test_sections_go_out_in_batches_of_bounded_size(spark, monkeypatch):
    """A batch of rows gave one batch of lines, each with its heading."""
    sent, send = [], X.sections_batch
    monkeypatch.setattr(X, "sections_batch", lambda b, rows, at, heads, lines: sent.append(sum(len(x or "") for x in (*heads, *lines))) or send(b, rows, at, heads, lines))
    monkeypatch.setattr(X, "SENT", 10_000)
    made = []

    class Texts:  # runs what the workers would
        schema = spark.createDataFrame([], "doc long, t string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            texts = ["# " + "h" * 200 + "\nx" * 300, None, "", *["a\n# b\nc"] * 1_200]
            made.extend(run([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "t"])]))

    X.scan_sections(Texts(), "doc", "t", "# ")
    rows = pa.Table.from_batches(made).to_pylist()
    assert max(sent) <= 10_000 + 500 and len(sent) > 6
    assert len(rows) == 301 + 1 + 3 * 1_200 and [r["pos"] for r in rows[:301]] == list(range(301)) and {r["section"] for r in rows[:301]} == {"h" * 200}
    assert [(r["section"], r["line"]) for r in rows[-3:]] == [(None, "a"), ("b", "# b"), ("b", "c")]


def test_keywords_are_counted_few_rows_at_a_time(spark, monkeypatch):
    """The hits of a whole batch were held together."""
    seen, count = [], K.Scanner.count
    monkeypatch.setattr(K.Scanner, "count", lambda self, data, offsets: seen.append(len(offsets) - 1) or count(self, data, offsets))
    made, docs = [], spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, _: made.append(run))
    K.counted(docs, ["data", "of the"])
    texts = [["data of the database", "of the metadata", ""][i % 3] for i in range(3_001)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_001), pa.int64()), pa.array(texts)], names=["doc", "__t"])
    rows = pa.Table.from_batches(made[0](iter([batch]))).to_pylist()
    assert max(seen) <= 500 and sum(seen) == 3_001
    want = [[("data", 2), ("of the", 1)], [("of the", 1)], []]
    assert [[(h["keyword"], h["n"]) for h in r["hits"]] for r in rows] == [want[i % 3] for i in range(3_001)] and [r["words"] for r in rows[:3]] == [4, 3, 1]
    assert [r["doc"] for r in rows] == list(range(3_001))


def test_documents_of_equal_categories_share_their_lists(spark):
    lex = spark.createDataFrame([("alpha", "1", True), ("gamma", "2", True)], "keyword string, category string, is_specific boolean")
    docs = spark.createDataFrame([(i, ("alpha", "gamma", "alpha gamma", "none", None)[i % 5]) for i in range(300)] + [(None, "alpha")], "doc_id long, text string")
    reqs = spark.createDataFrame([(i, str(1 + i % 3), i % 2 == 0, [f"k{i % 4}"], [f"m{i % 5}"]) for i in range(200)], "id long, category string, mandatory boolean, risks array<string>, mitigations array<string>")
    incs = spark.createDataFrame([(i, str(1 + i % 2), [f"k{i % 3}"]) for i in range(20)], "id long, category string, risks array<string>")
    rows, most = most_joined(P.retrieve(docs, lex, ["alpha", "gamma"], reqs.select("id", "category", "mandatory"), incs.select("id", "category"), 25))
    got = {r["doc"]: (r["categories"], r["requirements"], r["incidents"]) for r in rows}
    first = lambda cats: [i for _, i in sorted((i % 2, i) for i in range(200) if str(1 + i % 3) in cats)][:25]
    assert len(rows) == 181 and got[None] == (["1"], [], []) and most <= 400
    assert got[0] == (["1"], first({"1"}), [0, 2, 4]) and got[2] == (["1", "2"], first({"1", "2"}), [0, 2, 4, 1, 3, 5]) and got[297] == got[2]
    none = {"signals": ["zzz"], "strong": ["zzz"], "category": "9"}
    bias = {"bias": ["zzz"], "systemic": ["zzz"], "individual": ["zzz"], "drop": ["9"], "systemic_adds": ["9"], "individual_adds": ["9"]}
    rows, most = most_joined(P.retrieve_all(docs, lex, ["alpha", "gamma"], reqs, incs, none, bias))
    tf = {}
    for i in range(200):
        if i % 3 == 0:
            tf[f"k{i % 4}"] = tf.get(f"k{i % 4}", 0) + 1
    for i in (0, 2, 4):
        tf[f"k{i % 3}"] += 1
    assert {(r["category"], r["tf"]) for r in rows if r["doc"] == 0 and r["part"] == "risk"} == set(tf.items())
    assert [r["id"] for r in sorted((r for r in rows if r["doc"] == 0 and r["part"] == "incident"), key=lambda r: r["place"])] == [0, 2, 4]
    assert {r["category"] for r in rows if r["doc"] == 297 and r["part"] == "mitigation"} == {f"m{i}" for i in range(5)}
    assert sum(r["part"] == "requirement" for r in rows) == sum(i % 3 < 2 for i in range(200)) and most <= 400  # one row a document, not one a document and requirement
