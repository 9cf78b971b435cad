"""Small cases with known results, among them the traps of undefined statistics."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tallyrod.functions import text as T
from tallyrod.operators import agreement as A
from tallyrod.operators import graph as G
from tallyrod.operators import lexicon as L
from tallyrod.operators import rules as R
from tallyrod.operators import setmetrics as S
from tallyrod.operators import similarity as V
from tallyrod.sources import tables as X
from tallyrod.streaming.rowwise import run_available


def rows(df):
    return [tuple(r) for r in df.collect()]


def cells(spark, *values):
    return spark.createDataFrame(list(values), "a string, b string, n long")


def test_kappa_of_constant_raters(spark):
    one = cells(spark, ("x", "x", 5))
    assert rows(A.cohen_kappa(one)) == [(1.0,)]
    assert rows(A.kappa_strict(one)) == [(None,)]
    assert math.isnan(rows(A.krippendorff_alpha(one))[0][0])


def test_kappa_of_two_raters(spark):
    t = cells(spark, ("x", "x", 20), ("x", "y", 5), ("y", "x", 10), ("y", "y", 15))
    assert rows(A.cohen_kappa(t))[0][0] == pytest.approx(0.4)
    assert rows(A.raw_agreement(t))[0][0] == pytest.approx(0.7)


def test_tag_decisions_equal_the_product(spark):
    d = spark.createDataFrame([(1, [1, 2], [2, 3]), (2, [], [4]), (3, [5], [5])], "item int, a_tags array<int>, b_tags array<int>")
    got = {(a, b): n for a, b, n in rows(A.binary_decisions(d, [], 6))}
    want = {}
    for _, a, b in [(1, [1, 2], [2, 3]), (2, [], [4]), (3, [5], [5])]:
        for t in range(1, 7):
            k = (int(t in a), int(t in b))
            want[k] = want.get(k, 0) + 1
    assert got == want


def test_gap_equal_to_the_band_is_discriminable(spark):
    s = spark.createDataFrame([("p", 0.5), ("q", 0.25), ("r", float("nan"))], "assessor string, kappa double")
    got = {(r["a"], r["b"]): r["verdict"] for r in A.decision_rule(s, spark.createDataFrame([(0.25,)], "noise_band double")).collect()}
    assert got == {("p", "q"): "discriminable", ("p", "r"): "missing_data", ("q", "r"): "missing_data"}


def test_published_decisions(spark):
    """Six pairs from four known kappas and a band of 0.249: none is discriminable."""
    s = spark.createDataFrame([("a", 0.124), ("b", 0.336), ("c", 0.093), ("d", 0.154)], "assessor string, kappa double")
    v = A.decision_rule(s, spark.createDataFrame([(0.249,)], "noise_band double"))
    assert v.where("verdict = 'not discriminable'").count() == 6
    assert rows(A.kill_flag(v)) == [(True, True)]


def test_mcnemar(spark):
    d = spark.createDataFrame([("x", "x", "y")] * 8 + [("x", "y", "x")] * 2 + [("x", "x", "x")] * 5, "ref string, a string, b string")
    want = 2 * sum(math.comb(10, i) for i in range(3)) / 2**10
    assert rows(A.mcnemar_exact(d, "a", "b", "ref")) == [(8, 2, pytest.approx(want))]
    assert rows(A.mcnemar_exact(d.where("a = b"), "a", "b", "ref"))[0][2] == 1.0


def test_leave_one_out_equals_reruns(spark):
    data = [(i, r, 1 if r <= 3 else 2, (r - 1) % 3 + 1, "xyz"[(i * r + i // 3) % 3]) for i in range(9) for r in range(1, 7)]
    ann = spark.createDataFrame(data, "item int, rater int, stratum int, run int, label string")
    data += [(20, 1, 1, 1, "x"), (20, 2, 1, 2, "w"), (21, 4, 2, 1, "x"), (21, 5, 2, 2, "x"), (22, 1, 1, 1, "z")]  # few pairs, a label of their own
    ann = spark.createDataFrame(data, "item int, rater int, stratum int, run int, label string")
    got = {r["measure"]: (r["least"], r["most"]) for r in A.leave_one_out(ann).collect()}
    left = lambda i: ann.where(F.col("item") != i)
    items = [*range(9), 20, 21]
    within = [A.within_stratum(left(i)) for i in items]
    for name, each in (("within", [A.overall(w).first()[0] for w in within]), ("ceiling", [A.ceiling(w).first()["ceiling"] for w in within]), ("cross", [A.cross_stratum(left(i)).first()[0] for i in range(9)])):
        assert got[name] == (pytest.approx(min(each)), pytest.approx(max(each)))


def test_bootstrap_is_like_redrawn_items(spark):
    import numpy as np

    r = np.random.default_rng(1)
    data = [(i, int(a), int(a if u < 0.7 else b)) for i, (a, b, u) in enumerate(zip(r.integers(0, 3, 200), r.integers(0, 3, 200), r.random(200), strict=True))]
    own = spark.createDataFrame(data, "item int, a int, b int").withColumn("n", F.lit(1))

    def kappa(rows_):
        t = np.zeros((3, 3))
        for _, a, b in rows_:
            t[a, b] += 1
        t /= t.sum()
        e = (t.sum(1) * t.sum(0)).sum()
        return (np.trace(t) - e) / (1 - e)

    values = sorted(kappa([data[i] for i in r.integers(0, 200, 200)]) for _ in range(2000))
    got = A.bootstrap_ci(own, A.kappa_stat([]), 2000, 3).first()
    assert got["point"] == pytest.approx(kappa(data)) and got["mean"] == pytest.approx(np.mean(values), abs=0.01)
    assert got["lo"] == pytest.approx(values[50], abs=0.015) and got["hi"] == pytest.approx(values[1950], abs=0.015)
    assert A.bootstrap_ci(own.repartition(5), A.kappa_stat([]), 2000, 3).first() == got
    m = spark.createDataFrame([(i, float(i % 10)) for i in range(300)], "item int, m double")
    got = A.bootstrap_mean_ci(m, "m", 2000, 4).first()
    half = 1.96 * np.std(np.arange(300) % 10) / math.sqrt(300)
    assert got["point"] == 4.5 and got["lo"] == pytest.approx(4.5 - half, abs=0.06) and got["hi"] == pytest.approx(4.5 + half, abs=0.06)


def test_little_bootstraps_are_near_the_full_one(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = r.gamma(2.0, 3.0, 20_000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "item int, m double")
    got = A.little_bootstraps_ci(df, "m", 4).first()
    full = np.sort([r.choice(x, len(x)).mean() for _ in range(400)])
    width = full[390] - full[9]
    assert got["point"] == pytest.approx(x.mean()) and got["mean"] == pytest.approx(x.mean(), abs=0.05 * width)
    assert abs(got["lo"] - full[9]) < 0.15 * width and abs(got["hi"] - full[390]) < 0.15 * width
    assert A.little_bootstraps_ci(df.repartition(7), "m", 4).first() == got
    assert A.little_bootstraps_ci(df.limit(0), "m", 4).first()["lo"] is None


def test_headline_is_ordered(spark):
    data = [(i, r, 1 if r <= 3 else 2, (r - 1) % 3 + 1, "xy"[(i + (r > 3) * (i % 2)) % 2]) for i in range(12) for r in range(1, 7)]
    ann = spark.createDataFrame(data, "item int, rater int, stratum int, run int, label string")
    r = A.headline_test(ann, 20, (1, 2)).first()
    assert r["within_point"] == 1.0 and r["within_lo"] <= r["within_point"] and r["verdict"] == "supported"


def test_missing_runs_are_flips(spark):
    d = spark.createDataFrame([("m", 1, 1, "x"), ("m", 1, 2, "x"), ("m", 1, 3, "y"), ("m", 2, 1, None), ("m", 3, 1, "y"), ("m", 3, 2, "x")], "assessor string, item int, run int, label string")
    got = {r["item"]: (r["mode"], round(r["flip"], 3)) for r in A.flip_rates(d).collect()}
    assert got == {1: ("x", 0.6), 2: (None, 1.0), 3: ("y", 0.8)}


def test_recovery_falls(spark):
    ref = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "item int, label string")
    curve = {r["rate"]: r["kappa"] for r in A.recovery_test(ref, [0.0, 0.3, 0.9], 3, ["a", "b", "c"], 1).collect()}
    assert curve[0.0] == 1.0 > curve[0.3] > curve[0.9]
    # Of three labels in equal shares, kappa is 1 - 1.5 * rate in the mean.
    ref = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(3000)], "item int, label string").repartition(3)
    for r in A.recovery_test(ref, [0.1, 0.5, 1.0], 50, ["a", "b", "c"], 1).collect():
        assert r["kappa"] == pytest.approx(1 - 1.5 * r["rate"], abs=0.01)


def test_set_conventions(spark):
    d = spark.createDataFrame([([], []), ([], [1]), ([1], []), ([1, 2], [2, 3])], "p array<int>, e array<int>")
    get = lambda c: [tuple(None if x is None else round(x, 3) for x in r) for r in d.select(*S.set_prf(F.col("p"), F.col("e"), c)).collect()]
    assert get("score") == [(0, 1, 0), (0, 0, 0), (0, 1, 0), (0.5, 0.5, 0.5)]
    assert get("flags")[0][:2] == (1, 1) and get("skip")[0][1] is None


def test_error_codes(spark):
    d = spark.createDataFrame([(1, 2, 1, ["a", "b", "c"], ["a", "b"], ["a", "z"], ["r"], ["r", "s"], ["k"], ["k", "m"])], "item int, level int, ref_level int, expected array<string>, retrieved array<string>, cited array<string>, rights array<string>, ref_rights array<string>, categories array<string>, ref_categories array<string>")
    assert sorted(rows(S.error_taxonomy(d))) == [(1, "E1", "1>2"), (1, "E3", "c"), (1, "E4", "b"), (1, "E5", "s"), (1, "E7", "z"), (1, "E8", "m")]


def test_closure_and_cycle(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a")], "child string, parent string")
    assert set(rows(G.closure(e))) == {("a", "a"), ("b", "b"), ("c", "c"), ("c", "b"), ("b", "a"), ("c", "a")}


def test_keyword_rules(spark):
    d = spark.createDataFrame([(1, "Staff and employees; employee rights. artifact art"), (2, "")], "doc_id int, text string")
    got = {(r["doc"], r["keyword"]): r["n"] for r in L.keyword_counts(d, ["employee", "art", "staff", "and employees"]).collect()}
    assert got == {(1, "employee"): 2, (1, "art"): 2, (1, "staff"): 1, (1, "and employees"): 1}


def test_disambiguation_paths(spark):
    d = spark.createDataFrame([(1, "bias in bibliometric data", ["x"]), (2, "bias against a person", ["x"]), (3, "bias", ["x"]), (4, "none", ["x"])], "doc int, text string, categories array<string>")
    got = {r["doc"]: (r["categories"], r["path"]) for r in L.disambiguate(d, ["bias"], ["bibliometric"], ["person"], ["x"], ["y", "z"], ["w"]).collect()}
    assert got == {1: (["y", "z"], "systemic"), 2: (["w", "x"], "individual"), 3: (["x"], "neither"), 4: (["x"], "no bias word")}


def test_rules_fire_and_are_cleared(spark):
    feats = spark.createDataFrame([(1, ["a"]), (2, ["a", "s"]), (3, ["a", "b"])], "doc int, features array<string>")
    rules = spark.createDataFrame([("r", "d", 1, None, ["a"], [], ["s"], [], "m"), ("c", "d", None, None, [], ["a", "b"], [], ["d", "e"], "m")], "rule_id string, dimension string, priority int, severity string, any_of array<string>, all_of array<string>, none_of array<string>, compound array<string>, message string")
    assert {(r["doc"], r["rule_id"]) for r in R.apply_rules(feats, rules).collect()} == {(1, "r"), (3, "r"), (3, "c")}
    assert R.apply_compound_rules(feats, rules).first()["dimensions"] == ["d", "e"]


def test_negation_guard(spark):
    d = spark.createDataFrame([(1, "consent was not obtained"), (2, "we have not yet obtained"), (3, "it was obtained")], "doc_id int, text string")
    got = {r["doc"]: r["features"] for r in R.extract_features(d, [("obtained", "ok", True)], ["not", "no"]).collect()}
    assert got == {1: [], 2: [], 3: ["ok"]}


def test_one_risk_with_the_wrong_mitigation(spark):
    items = spark.createDataFrame([("i", ["c"], ["q"], ["w"], 0), ("j", ["c"], [], [], 0), ("k", ["c"], ["q"], ["m"], 0)], "item string, risks array<string>, requirements array<string>, mitigations array<string>, free_mitigations int")
    lists = spark.createDataFrame([("c", ["m"])], "category string, mitigations array<string>")
    got = {r["item"]: tuple(r)[2:] for r in R.consistency_check(items, lists).collect()}
    assert got == {"i": (True, True, False), "j": (False, False, False), "k": (True, True, True)}


def test_noisy_json(spark):
    d = spark.createDataFrame([('so:\n```json\n{"k": 1}\n``` ok {',), ('x {"k": 2} y',), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(T.json_object(F.col("t"), "k int")["k"]).collect()] == [1, 2, None, None]


def test_triples(spark):
    lines = ["<http://x/s> <http://x/p> <http://x/o> .", '<http://x/s> <http://x/p> "a \\"b\\""@en .', '_:b <http://x/p> "1"^^<http://x/int> .', "# no", ""]
    got = rows(X.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert got == [("http://x/s", "http://x/p", "http://x/o", "uri", None, None), ("http://x/s", "http://x/p", 'a \\"b\\"', "literal", None, "en"), ("_:b", "http://x/p", "1", "literal", "http://x/int", None)]


def test_assessments(spark, tmp_path):
    good = {"proposal_id": "P1", "assessment": {"identified_risks": [{"risk": "r"}], "error": None}}
    for name, text in {"P1_full.json": json.dumps(good), "P2_FAILED_full.json": json.dumps(good), "P3_full.json": "{broken", "P4_full.json": json.dumps({"proposal_id": "P4", "assessment": {"error": "e"}}), "x.json": json.dumps(good)}.items():
        (tmp_path / name).write_text(text)
    docs = X.read_assessments(spark, str(tmp_path), "proposal_id string, assessment struct<identified_risks array<struct<risk string>>, error string>")
    assert [r["proposal_id"] for r in docs.collect()] == ["P1"]
    assert [r["key"] for r in X.file_key(docs, [r"^(Q\d+)_", r"^(P\d+)_"]).collect()] == ["P1"]


def test_annotations_and_report(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"item": "i", "x": 1.5}, {"item": "j", "x": None}]))
    read = lambda n: X.read_annotations(spark, str(tmp_path / "a.json"), n, "item string, x double")
    assert read(2).count() == 2
    with pytest.raises(ValueError, match="at least 3"):
        read(3)
    X.write_report(read(2).withColumn("x", F.lit(float("nan"))), str(tmp_path / "out"))
    assert spark.read.schema("item string, x double").json(str(tmp_path / "out")).where("x is null").count() == 2


def test_last_wins_and_first_seen(spark):
    d = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 3, "c")], "key string, at int, v string")
    assert set(rows(G.last_wins(d, ["key"], ["at"]))) == {("k", 2, "b"), ("m", 3, "c")}
    assert set(rows(G.first_seen_dedupe(d, ["key"], ["at"]))) == {("k", 1, "a"), ("m", 3, "c")}


def test_top_up(spark):
    a = spark.createDataFrame([(1, ["S"]), (2, ["D"]), (3, ["D"]), (4, ["D"])], "id int, categories array<string>")
    got = rows(L.top_up(a, spark.createDataFrame([("S",), ("D",)], "category string"), "D", 3))
    assert {i for i, c in got if c == "S"} == {1, 2, 3}


def test_components_that_are_no_cliques(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    got = sorted(rows(V.near_duplicate_groups(p)))
    assert got == [(1, 1, 3, 2, False), (1, 2, 3, 2, False), (1, 3, 3, 2, False), (7, 7, 2, 1, True), (7, 8, 2, 1, True)]


def test_components_of_a_long_chain(spark):
    p = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {(r["root"], r["n"]) for r in V.near_duplicate_groups(p).collect()} == {(0, 61)}


def test_similar_pairs_in_many_blocks(spark):
    v = spark.createDataFrame([(i, "ab"[i % 2], [math.cos(i / 9), math.sin(i / 9)]) for i in range(60)] + [(90, "a", None), (91, "b", [])], "id long, grp string, v array<double>")
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if math.cos((i - j) / 9) >= 0.9 and (i - j) % 2)
    for n in (1, 7, None):
        assert sorted((r["a"], r["b"]) for r in V.similar_pairs(v, 0.9, True, n).collect()) == want


def test_projection(spark):
    got = rows(A.projection(spark.createDataFrame([(0.6,)], "mean double"), 40, [80]))
    assert got[0][2] == pytest.approx(2 * 0.6 / 1.6)


def test_row_wise_operators_stream(spark, tmp_path):
    """A stream's rows get what the batch's rows get, also in a second run from the checkpoint."""
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    df = spark.createDataFrame([(1, "License data"), (2, "none")], "doc_id int, text string")
    op = lambda d: R.extract_features(d, [("license", "l", False), ("data", "d", False)])
    df.write.parquet(src)
    for _ in range(2):
        run_available(spark.readStream.schema(df.schema).parquet(src), op, out, cp).awaitTermination()
        assert sorted(rows(spark.read.parquet(out))) == sorted(rows(op(spark.read.parquet(src))))
        df.withColumn("doc_id", F.col("doc_id") + 10).write.mode("append").parquet(src)
