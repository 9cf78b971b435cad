"""Order statistics by ranges, closures in rounds, sections inside the row."""

import random

import pytest
from pyspark.sql import functions as F

from tallyrod.operators import graph as G
from tallyrod.sources import tables as X


@pytest.mark.parametrize("most", [5, 50, G.SORTED])
def test_element_at_any_place(spark, most):
    r = random.Random(1)
    values = [r.choice([r.random(), r.randint(0, 5) / 1.0, -7.5]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value double").repartition(3)
    assert G.upper_median(df, "value", most=most).first()[0] == sorted(values)[200]
    counts = df.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    for place in (0, 399):
        assert G.element_at_place(counts, place, most).first()[0] == sorted(values)[place]
    assert G.element_at_place(counts, 400, most).count() == 0


def test_median_of_many_distinct_values(spark):
    df = spark.range(1_000_000).select((F.xxhash64("id") / 1e6).alias("value"))
    got = G.upper_median(df, "value")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Filter" in plan
    want = df.orderBy("value").offset(500_000).limit(1).first()[0]
    assert got.first()[0] == want


def test_closure_of_chains_trees_and_diamonds(spark):
    n = 700
    chain = [(f"c{i}", f"c{i + 1}") for i in range(n)]
    tree = [(f"t{i}", f"t{(i - 1) // 50}") for i in range(1, 3000)]
    diamond = [("d", "e"), ("d", "f"), ("e", "g"), ("f", "g"), ("f", "h"), ("h", "g")]
    up = {}
    for c, p in chain + tree + diamond:
        up.setdefault(c, []).append(p)

    def above(x, seen):
        for p in up.get(x, []):
            if p not in seen:
                seen.add(p)
                above(p, seen)
        return seen

    edges = spark.createDataFrame(chain + tree + diamond + [(None, "x")], "child string, parent string").repartition(3)
    got = G.closure(edges)
    assert got.where("node like 'c%'").count() == (n + 1) * (n + 2) // 2
    rest = got.where("node not like 'c%'").collect()
    want = {(x, a) for x in {v for e in tree + diamond for v in e} for a in {x} | above(x, set())}
    assert len(rest) == len(want) and set(map(tuple, rest)) == want
    some = G.ancestors_of(spark.createDataFrame([("d",), ("t2999",), ("none",)], "node string"), edges)
    assert set(map(tuple, some.collect())) == {(x, a) for x in ("d", "t2999", "none") for a in {x} | above(x, set())}
    with pytest.raises(RuntimeError):
        G.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), 5)


def test_sections_stay_in_their_rows(spark, tmp_path):
    texts = [None, "", "a\n## B\nc\n\n## D\n## \ne", "## x", "no heading\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, t in enumerate(texts):
        head = None
        for pos, line in enumerate(t.split("\n") if t is not None else []):
            head = line[3:] if line.startswith("## ") else head
            want.append((i, pos, head, line))
    got = X.scan_sections(docs, "doc_id", "text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    docs.write.parquet(f"{tmp_path}/in")
    stream = X.scan_sections(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), "doc_id", "text")
    run = stream.writeStream.format("memory").queryName("sections").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("sections").count() == len(want)
