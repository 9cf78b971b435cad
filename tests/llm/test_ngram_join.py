"""The n-gram join and its components against comparing every pair."""

import random

import pytest

from tallyrod.llm import ngram_join
from tallyrod.llm.components import components


def brute(docs, n, num, den):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(docs):
        out[i] = (d, len(sets[i]), min(docs[k][0] for k in range(len(docs)) if find(k) == find(i)))
    return sorted(out.values())


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(50)]
    docs = []
    for _ in range(60):
        docs.append([word() for _ in range(r.choice([1, 2, 3, 5, 9, 20, 60, 150]))])
    for _ in range(50):  # a passage shared by many, with own words
        docs.append([word() for _ in range(r.randint(0, 40))] + passage + [word() for _ in range(r.randint(0, 10))])
    base = [word() for _ in range(120)]
    for _ in range(60):  # one group of near copies with ever more changes
        d = list(base)
        for _ in range(r.randint(0, 6)):
            d[r.randrange(len(d))] = word()
        docs.append(d)
    chain = [word() for _ in range(80)]
    for _ in range(25):  # each a near copy of the one before
        chain = list(chain)
        chain[r.randrange(80)] = word()
        docs.append(chain)
    docs += [docs[3], docs[70], docs[70]]
    r.shuffle(docs)
    return [(i, r.choice([" ", "\n"]).join(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (902, " \t ")]


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 4, 85), (2, 5, 80)])
def test_same_as_all_pairs(spark, seed, n, num):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, cls string, size int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, n, num, 100).collect())
    assert got == brute(docs, n, num, 100)


def test_one_of_each_group_stays(spark):
    docs = [(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (8, None), (9, ""), (None, "q r s t u v"), (7, "x y")]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, root int")
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_each(df).collect()]
    assert sorted(got, key=str) == sorted([(3, "A b c d e f"), (8, None), (9, ""), (None, "q r s t u v"), (7, "x y")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(df).count() == 0


def test_linked_sets_share_a_signature():
    import numpy as np

    r = np.random.default_rng(3)
    for num in (80, 85):
        bands, n = ngram_join.Bands(num, 100), 0
        for _ in range(4000):
            size = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**64, size, dtype="uint64"))
            keep = a[r.random(len(a)) > r.random() * 0.16]
            b = np.unique(np.concatenate([keep, r.integers(0, 2**64, int(r.integers(0, 2 + size // 9)), dtype="uint64")]))
            if len(b) and ngram_join.linked(a, b, num, 100) and not np.array_equal(a, b):
                n += 1
                sigs, owner = bands.signatures([a, b])
                assert len(np.intersect1d(sigs[owner == 0], sigs[owner == 1]))
                assert ngram_join.possible(ngram_join.sketch(a), len(a), ngram_join.sketch(b), len(b), num, 100)
        assert n > 500


def test_signatures_do_not_depend_on_the_other_sets():
    import numpy as np

    r, bands = np.random.default_rng(4), ngram_join.Bands(85, 100)
    sets = [np.unique(r.integers(0, 2**64, int(n), dtype="uint64")) for n in r.integers(1, 300, 60)]
    sigs, owner = bands.signatures(sets)
    for i, s in enumerate(sets):
        assert sorted(sigs[owner == i]) == sorted(bands.signatures([s])[0])


@pytest.mark.parametrize("most", [8, 4096])
def test_a_large_group_and_a_chain(spark, monkeypatch, most):
    # Small: groups above the limit, which go through slices and the prefix filter.
    monkeypatch.setattr(ngram_join, "MOST", most)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(250):
        d = list(base)
        for _ in range(r.randint(0, 4)):
            d[r.randrange(60)] = f"x{r.randrange(1000)}"
        texts.append(d)
    chain = [f"c{i}" for i in range(70)]
    for i in range(45):
        chain = list(chain)
        chain[i] = f"d{i}"
        texts.append(chain)
    r.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 4, 85, 100).collect()
    assert sorted(tuple(x[k] for k in ("doc_id", "n_shingles", "component_id")) for x in got) == brute(docs, 4, 85, 100)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
