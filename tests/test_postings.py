"""Stored postings and passages against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from tallyrod.operators import lexicon as L
from tallyrod.operators import passages as P
from tallyrod.operators import postings as I


def plain_bm25(queries, corpus, k1=1.5, b=0.75, floor=0.25):
    docs = {i: re.findall("[a-z]+", (t or "").lower()) for i, t in corpus}
    avg = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for w in docs.values() for t in set(w))
    idf = {t: math.log((len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    out = {}
    for q, text in queries:
        want = Counter(re.findall("[a-z]+", text.lower()))
        for i, w in docs.items():
            tf = Counter(w)
            s = [(floor * mean if idf[t] < 0 else idf[t]) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / avg)) * n for t, n in want.items() if t in tf]
            if s:
                out[q, i] = sum(s)
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefg" for b in "hijkl"]
    return [(i, " ".join(r.choice(words[: r.choice([3, 35])]) for _ in range(r.randint(0, 50))) or None) for i in range(120)]


def test_bm25_from_the_index(spark, corpus):
    queries = [(1000, "Ah bh zz ah"), (1001, corpus[5][1] or "ch"), (1002, "zz")]
    index = I.build(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3), "doc_id", "text")
    q = L.term_counts(spark.createDataFrame(queries, "id long, text string"), "id", "text", "[a-z]+")
    got = {(r["query"], r["doc"]): r["score"] for r in I.bm25(q, index).collect()}
    want = plain_bm25(queries, corpus)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    n, avg = index.stats().first()
    assert n == len(corpus) and avg == pytest.approx(sum(len((t or "").split()) for _, t in corpus) / len(corpus))


def test_only_the_folders_of_the_terms_are_read(spark, corpus):
    index = I.build(spark.createDataFrame(corpus, "doc_id long, text string"), "doc_id", "text")
    hits = index.of(spark.createDataFrame([("ah",)], "term string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or re.search(r"PartitionFilters: \[.*bucket", plan)
    assert hits.count() == sum("ah" in (t or "").split() for _, t in corpus)
    empty = I.build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert I.bm25(L.term_counts(spark.createDataFrame([(1, "ah")], "id long, text string"), "id", "text", "[a-z]+"), empty).count() == 0


def test_passages(spark):
    r = random.Random(4)
    word = lambda: r.choice(["abc", "é", "de", "f", "中文", "ghij", "  "])
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 150)))) for i in range(60)] + [(70, None), (71, ""), (3, "f de f")]
    cut = [(t[a : a + n]) for _, t in docs[:40] for a, n in [(r.randint(0, 60), r.choice([1, 2, 3, 7, 15, 33, 64, 200]))]]
    wanted = [*enumerate(cut), (500, None), (501, ""), (502, "not there at all, surely not"), (503, cut[0]), (504, "f")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    p = spark.createDataFrame(wanted, "query long, passage string")
    want = sorted({(q, i) for q, x in wanted if x for i, t in docs if t and x in t})
    for most in (P.MOST, 7):
        assert sorted(map(tuple, P.find_passages(d, p, most=most).collect())) == want
    plan = P.find_passages(d, p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert P.find_passages(d, p.limit(0)).count() == 0 and P.find_passages(d.limit(0), p).count() == 0


def test_long_texts_are_found_piece_by_piece(monkeypatch):
    import pyarrow as pa

    t = ["x" * 50 + "a passage that lies across the pieces" + "y" * 50, "", "a passage", "a passage that lies across"]
    raw = [b"a passage that lies across the pieces", b"a passage", b"x"]
    keys = [(*P._anchor(x), len(x), int.from_bytes(P.hashlib.sha256(x).digest()[:8], "big", signed=True)) for x in raw]
    data, offsets = P.text_buffers(pa.array(t))
    whole = P.Finder(keys).find(data, offsets)
    monkeypatch.setattr(P, "PIECE", 3)
    assert P.Finder(keys).find(data, offsets) == whole and len(whole) == 5


def test_the_best_without_all_scores(spark, corpus, monkeypatch):
    docs = [*corpus, *((200 + i, corpus[5][1]) for i in range(30)), (7, corpus[7][1]), (8, "ah ah bh"), (None, "ah bh")]  # copies, repeated rows and ids
    queries = [(1000, "Ah bh zz ah"), (1001, corpus[5][1] or "ch"), (1002, "zz"), (1003, "gl")]
    index = I.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text")
    q = L.term_counts(spark.createDataFrame(queries, "id long, text string"), "id", "text", "[a-z]+")
    rank = lambda s, most: {(r["query"], r["doc"]): (r["rank"], pytest.approx(r["score"])) for r in L.rank_results(s).collect() if r["rank"] <= most.get(r["query"], 4)}
    sizes = spark.createDataFrame([(1000, 25), (1003, 1)], "query long, size long")
    for per_pass in (I.QUERIES, 1):
        monkeypatch.setattr(I, "QUERIES", per_pass)
        some = I.bm25_best(q, index, 4, sizes)
        assert rank(some, {1000: 25}) == rank(I.bm25(q, index), {1000: 25})
        assert rank(I.tfidf_best(q, index, 4), {}) == rank(I.tfidf_cosine(q, index), {})
    assert some.count() < I.bm25(q, index).count()
    assert I.bm25_best(q.limit(0), index, 4).count() == 0
