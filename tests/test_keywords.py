"""Keyword counts of any number of keywords against plain patterns."""

import random
import re

import numpy as np
import pyarrow as pa

from tallyrod.operators import keywords as K


def brute(text, keyword):
    if not keyword:
        return 0
    if K.begins_words(keyword):
        return len(re.findall(rf"(?:^|[\W]){re.escape(keyword)}", text))
    return text.count(keyword)


def scanned(keywords, texts):
    data, offsets = K.text_buffers(pa.array(texts, pa.string()))
    return K.Scanner(keywords).count(data, offsets), K._word_counts(data, offsets)


def test_counts_of_random_texts():
    r = random.Random(2)
    for _ in range(300):
        letters = r.choice(["ab", "ab c", "abé_ -1"])
        word = lambda n: "".join(r.choice(letters) for _ in range(n))
        texts = [word(r.randint(0, 40)) for _ in range(r.randint(1, 8))]
        own = list({word(r.randint(0, 12)) for _ in range(25)} | {"aa", "aaaaaa", "ab", "a a", "é"})
        own = [k for k in own if not K.begins_words(k) or re.fullmatch(r"\w+", k)]
        got, words = scanned(own, texts)
        assert got == {(i, j): n for i, t in enumerate(texts) for j, k in enumerate(own) if (n := brute(t, k))}
        assert words.tolist() == [max(1, len(t.encode().split())) for t in texts]


def test_pieces_of_long_texts(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "beta", "beta blocker", "ga", "é", "longer word"]) for _ in range(r.randint(0, 60))) for _ in range(20)]
    own = ["alpha", "beta blocker", "longer", "ga", "é", "a b", "blockerx"]
    whole = scanned(own, texts)
    for n in (1, 7, 64):
        monkeypatch.setattr(K, "PIECE", n)
        part = scanned(own, texts)
        assert part[0] == whole[0] and np.array_equal(part[1], whole[1])


def test_a_large_lexicon_in_one_pass(spark):
    r = random.Random(4)
    own = list({"".join(r.choice("abcdefgh") for _ in range(r.randint(2, 14))) for _ in range(21_000)})[:20_000]
    texts = [None, ""] + [" ".join(r.choice(own) if r.random() < 0.5 else "zzz" for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = K.counted(docs, own)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    rows = {x["doc"]: {h["keyword"]: h["n"] for h in x["hits"]} for x in got.collect()}
    assert set(rows) == set(range(len(texts))) and rows[0] == rows[1] == {}
    for i in (2, 9, 31):
        assert rows[i] == {k: n for k in own if (n := brute(texts[i], k))}
