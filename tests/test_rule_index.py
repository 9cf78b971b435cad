"""Many rules by the index against each document held against each rule."""

import random

from tallyrod.operators import rules as R
from tallyrod.plans.mirror import RULE_SCHEMA


def fires(features, rule):
    any_of, all_of, none_of = rule[4:7]
    return (not any_of or bool(features & set(any_of))) and set(all_of) <= features and not features & set(none_of)


def rule(i, any_of, all_of, none_of):
    return (f"r{i}", f"d{i % 5}", i % 7 or None, None if i % 3 else "Info", any_of, all_of, none_of, [], "m")


def found(df):
    return sorted((r["doc"], r["rule_id"]) for r in df.collect())


def test_same_findings_as_all_pairs(spark):
    r = random.Random(1)
    some = lambda n: [f"f{r.randint(0, 30)}" for _ in range(r.randint(0, n))]
    docs = [(i, some(12)) for i in range(80)] + [(3, some(5)), (90, [])]
    own = [rule(i, some(3), some(3), some(2)) for i in range(200)]
    features = spark.createDataFrame(docs, "doc long, features array<string>")
    rules = spark.createDataFrame(own, RULE_SCHEMA)
    want = sorted((d, x[0]) for d, f in docs for x in own if fires(set(f), x))
    assert found(R.apply_rules(features, rules)) == want
    assert found(R.apply_rules(features, rules, few=1_000)) == want
    by_join = R.candidates(features, rules, most=0)
    assert {(x["doc"], x["rule_id"]) for x in by_join.collect()} >= set(want)


def test_fifty_thousand_rules(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(20_000)]
    own = [rule(i, [], [r.choice(words), "common"], []) if i % 2 else rule(i, [r.choice(words) for _ in range(3)], [], ["never"]) for i in range(50_000)]
    docs = [(i, [*{r.choice(words) for _ in range(40)}, "common"]) for i in range(300)]
    features = spark.createDataFrame(docs, "doc long, features array<string>")
    rules = spark.createDataFrame(own, RULE_SCHEMA)
    pairs = R.candidates(features, rules)
    n = pairs.count()
    want = sorted((d, x[0]) for d, f in docs for s in [set(f)] for x in own if fires(s, x))
    assert found(R.apply_rules(features, rules)) == want and len(want) <= n <= 1.01 * len(want)  # of 15,000,000 pairs


def test_nulls_and_small_batches_as_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    some = lambda n: r.choice([None, [], *([r.choice([None, *"abcdefgh"]) for _ in range(r.randint(0, n))] for _ in range(8))])
    features = spark.createDataFrame([(r.choice([None, f"d{i}"]), some(6)) for i in range(700)], "doc string, features array<string>").coalesce(1)
    rules = spark.createDataFrame([rule(i, some(2), some(2), some(2)) for i in range(300)], RULE_SCHEMA)
    key = lambda x: (x["doc"] or "", x["rule_id"])
    want = sorted(map(key, R.apply_rules(features, rules, few=1_000).collect()))
    assert len(want) > 10_000 and sorted(map(key, R.apply_rules(features, rules).collect())) == want
    monkeypatch.setattr(R, "CELLS", 1)  # 256 documents at once
    assert sorted(map(key, R.apply_rules(features, rules).collect())) == want
    free = spark.createDataFrame([rule(i, [], [], []) for i in range(70)], RULE_SCHEMA)
    assert R.apply_rules(features, free).count() == 70 * features.where("features is not null").count()


def test_more_conditions_than_are_collected(spark):
    r = random.Random(4)
    some = lambda n: [f"f{r.randint(0, 20)}" for _ in range(r.randint(0, n))]
    docs, own = [(i, some(9)) for i in range(60)], [rule(i, some(3), some(2), some(2)) for i in range(150)]
    features, rules = spark.createDataFrame(docs, "doc long, features array<string>"), spark.createDataFrame(own, RULE_SCHEMA)
    want = sorted((d, x[0]) for d, f in docs for x in own if fires(set(f), x))
    assert found(R.apply_rules(features, rules, most=20)) == want
