"""Draws that a key and a seed fix."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrod.operators import agreement as A
from tallyrod.operators import draws as D


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % D.PRIME


def test_key_is_that_of_its_text(spark):
    rows = [("",), ("a,b;ü",), (None,), ("x" * 10_000,)]
    got = [r["h"] for r in spark.createDataFrame(rows, "t string").select(D.key_number(F.col("t"))).collect()]
    assert got == [number(t or "") for (t,) in rows]


def test_shares_are_even_and_independent():
    u = D.uniforms(np.array([number(str(i)) for i in range(300)]), D.seeds(7, 2000))
    assert 0 <= u.min() and u.max() < 1
    assert np.abs(np.histogram(u, 20, (0, 1))[0] / u.size - 0.05).max() < 0.001
    # Of pairs of keys over the replicates and of replicates over the keys.
    assert np.abs(np.corrcoef(u) - np.eye(300)).max() < 5.5 / math.sqrt(2000)
    assert np.abs(np.corrcoef(u[:, :300].T) - np.eye(300)).max() < 5.5 / math.sqrt(300)


@pytest.mark.parametrize("mean", [0.3, 1.0, 37.5, 1000.0, 2_000_000.0])
def test_poisson_table(mean):
    w = D.quantiles(np.linspace(0, 1, 200_001)[:-1], D.poisson_table(mean))
    assert w.mean() == pytest.approx(mean, abs=0.001 * math.sqrt(mean) + 1e-4 * mean / 1e3) and w.var() == pytest.approx(mean, rel=0.005)
    if mean < 100:  # against the plain sum
        lo, cdf = D.poisson_table(mean)
        plain = np.cumsum([math.exp(-mean) * mean**k / math.factorial(k) for k in range(lo + len(cdf))])
        assert lo == 0 and np.abs(cdf - plain).max() < 1e-12
        assert np.array_equal(D.quantiles((plain[:-1] + plain[1:])[25:40] / 2, (lo, cdf)), np.arange(26, 41)) or mean < 30


@pytest.mark.parametrize("n,p", [(0, 0.5), (9, 0.0), (9, 1.0), (1, 0.5), (12, 0.25), (100_000, 0.7)])
def test_binomial_table(n, p):
    w = D.quantiles(np.linspace(0, 1, 200_001)[:-1], D.binomial_table(n, p))
    assert 0 <= w.min() and w.max() <= n
    assert w.mean() == pytest.approx(n * p, abs=0.001 * math.sqrt(n) + 1e-9) and w.var() == pytest.approx(n * p * (1 - p), rel=0.005, abs=1e-9)
    if n == 12:
        plain = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n)])
        assert np.array_equal(D.quantiles(plain + 1e-12, D.binomial_table(n, p)), np.arange(1, n + 1))


def test_sums_of_replicates_are_those_of_single_draws(spark):
    """More patterns than a step takes, several rows an item, null keys, equal items."""
    data = [(i, "abc"[(i + j) % 3] if (i + j) % 7 else None, i % 151 + 1, 0.5 * j) for i in range(600) for j in range(i % 3 + 1)]
    df = spark.createDataFrame(data, "item int, k string, n long, x double")
    got = {(r["rep"], r["k"]): (r["n"], r["x"]) for r in A.replicate_sums(df.repartition(5), ["n", "x"], 40, 3).collect()}
    by_item = {}
    for i, k, n, x in data:
        by_item.setdefault(i, []).append((f"{k or ''},{n},{x}", k, n, x))
    counts = {}
    for rows in by_item.values():
        key = tuple(sorted(rows, key=lambda r: r[0]))
        counts[key] = counts.get(key, 0) + 1
    assert len(counts) > 128
    want = {}
    ab = D.seeds(3, 40)
    for rows, c in counts.items():
        drawn = D.quantiles(D.uniforms(np.array([number(";".join(r[0] for r in rows))]), ab)[0], D.poisson_table(float(c)))
        for rep, w in enumerate([c, *drawn], -1):
            for _, k, n, x in rows:
                at = want.setdefault((rep, k), [0.0, 0.0])
                at[0] += w * n
                at[1] += w * x
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert A.replicate_sums(df.limit(0), ["n", "x"], 40, 3).count() == 0


def test_one_item_takes_a_third_of_the_rows(spark):
    rows = [(0, "a", "a")] * 500 + [(i, "ab"[i % 2], "ab"[i % 3 % 2]) for i in range(1, 1000)]
    own = spark.createDataFrame(rows, "item int, a string, b string").groupBy("item", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    r = A.bootstrap_ci(own, A.kappa_stat([]), 500, 1).first()
    assert r["lo"] < r["point"] < r["hi"] and A.bootstrap_ci(own.repartition(1), A.kappa_stat([]), 500, 1).first() == r


def test_intervals_of_nothing(spark):
    own = spark.createDataFrame([], "item int, a string, b string, n long")
    none = dict.fromkeys(("point", "lo", "hi", "mean"))
    assert A.bootstrap_ci(own, A.kappa_stat([]), 20, 1).first().asDict() == none
    assert A.bootstrap_mean_ci(own.select("item", F.col("n").alias("m")), "m", 20, 1).first().asDict() == none
    ann = spark.createDataFrame([], "item int, rater int, stratum int, run int, label string")
    assert A.headline_test(ann, 20, (1, 2)).first()["verdict"] is None
