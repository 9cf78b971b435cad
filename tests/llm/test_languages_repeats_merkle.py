"""Language identification, periodic runs and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrod.llm import languages, merkle, repeats

DIR = "/root/testdata/sf0.01"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, leaf int, score double"


def table(spark, rows, n=3):
    """Rows (doc_id, text, lang) with columns of clashing names."""
    return spark.createDataFrame([(i, t, x, f"s{(i or 0) % 3}" if i else None, len(t) if t else None, "k", 1, 0.5) for i, t, x in rows], COLUMNS).repartition(n)


# Periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(6, 4 * q) and not any(words[a : a + length - p] == words[a + p : a + length] for p in range(1, q)):
                out.append((a, length, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    drop = {i for a, length, q in runs for i in range(a + q, a + length)}
    said = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(4000):
        words = [b"%d" % r.randint(0, r.choice([1, 2, 4])) for _ in range(r.randint(0, 70))]
        if words and r.random() < 0.6:  # words of a period, several times and inside one another
            for _ in range(r.randint(1, 3)):
                a, p = r.randrange(len(words)), r.randint(1, 9)
                words[a:a] = words[a : a + p] * r.randint(2, 7)
        assert [tuple(x) for x in repeats.runs_of(words).tolist()] == brute_runs(words)


def test_long_runs():
    assert repeats.runs_of([b"a"] * 30_000).tolist() == [[0, 30_000, 1]]
    words = [b"%d" % (i % 7_000) for i in range(30_000)]
    assert repeats.runs_of([b"x", *words, b"y"]).tolist() == [[1, 30_000, 7_000]]


def test_reports_of_texts(spark):
    r = random.Random(3)
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "A a a a a a a B", "a\x0bb\x0ca\rb a b a b\na b", "x y " * 9, "é " * 7, " ".join(["w"] * 5000)]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(1, 120))) for _ in range(150)]
    texts += [" ".join(f"v{r.randint(0, 500)}" for _ in range(r.randint(1, 200))) for _ in range(150)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[-1], None), (None, "b " * 8, "en"), (7, texts[7], "de"), (7, texts[7], "de")]
    got = repeats.report(table(spark, rows), plant=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_report(i, t) for i, t, _ in rows), key=str)
    assert any(r["n_runs"] > 1 for r in got)
    assert repeats.report(table(spark, []), plant=True).count() == 0


# The Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes, at):
    """(root, siblings of a place in order) of a run of digests."""
    out = []
    while len(nodes) > 1:
        k = at // 8 * 8
        out += [x for j, x in enumerate(nodes[k : k + 8], k) if j != at]
        nodes, at = [sha(*nodes[j : j + 8]) for j in range(0, len(nodes), 8)], at // 8
    return nodes[0], out


def brute_audit(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t, lang, source, n in rows:
        own = leaf(i, source, lang, n, t)
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        groups[lang].append(((i is not None, i or 0, own), i, own, leaf(i, source, lang, n, t and t.translate(upper)) if hit else own))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots = [climb([x[2] for x in sorted(groups[g])], 0)[0] for g in names]
    out = []
    for k, g in enumerate(names):
        nodes = [x[2] for x in sorted(groups[g])]
        root, high = climb(subroots, k)
        for j, (_, i, own, tested) in enumerate(sorted(groups[g])):
            sub, low = climb(nodes, j)
            assert sub == subroots[k]
            x = climb([*nodes[:j], tested, *nodes[j + 1 :]], j)[0]
            folded = climb([*subroots[:k], x, *subroots[k + 1 :]], k)[0]
            out.append((i, own, sub, root, sha(*low, *high), folded, folded == root))
    return out


def test_manifest(spark):
    r = random.Random(5)
    for n, langs in ((1, ["en"]), (9, ["en"]), (400, ["en"] * 30 + ["de", "fr", None, ""]), (150, [f"l{k}" for k in range(70)] + ["é", "Z"])):
        rows = [(None if i % 50 == 7 else i, r.choice([None, "", "abc", f"A Text {i} É", "plain"]), r.choice(langs)) for i in range(n)]
        rows += rows[:3] * 2
        df = table(spark, rows)
        own = [(x["doc_id"], x["text"], x["lang"], x["source"], x["n_chars"]) for x in df.collect()]
        want = sorted(brute_audit(own), key=str)
        for top in (merkle.TOP, 3):  # 3: most steps of the climb are shuffled joins
            assert sorted(map(tuple, merkle.audit(df, top).collect()), key=str) == want
    assert merkle.audit(table(spark, [])).count() == 0
    assert merkle.audit(table(spark, [])).columns == "doc_id leaf subroot root proof_sha256 folded_root verified".split()


# Languages


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert len(got) > 150 and right >= 0.99 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def syllables(r, kinds, n):
    return " ".join("".join(r.choice(kinds) for _ in range(r.randint(1, 4))) for _ in range(n))


KINDS = {"en": "th he in er an ou".split(), "de": "ei ch sch ung en er".split(), "fr": "eau qu é ai ou en".split(), "es": "ción ll que os ar en".split(), "xx": "zz yk qo vv".split()}


def test_predictions_do_not_depend_on_batches_or_long_texts(spark):
    r = random.Random(8)
    rows = [(i, syllables(r, KINDS[x], r.randint(1, 80)), x) for i, x in enumerate(list(KINDS) * 40)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, " 12 34 !", "de"), (903, syllables(r, KINDS["es"], 300_000), None), (904, "É", None), (None, rows[0][1], None), rows[5], rows[5]]
    docs = table(spark, rows)
    model = languages.learn(docs, ~languages.held_out(F.col("doc_id")), sample=60)
    assert model.languages == sorted(KINDS) and len(model.machines) == 3 + 1 + 1
    found = {}
    for n in (1, 7):
        out = languages.predict(docs.repartition(n), model, [F.col("doc_id"), F.col("lang")]).collect()
        found[n] = sorted(map(tuple, out), key=str)
    assert found[1] == found[7]
    by = {x[0]: x for x in found[1]}
    assert all(by[i][2:] == ("und", 0.0) for i in (900, 901, 902)) and by[903][2] == "es" and by[904][2] != "und"
    right = [x for x in found[1] if x[1] in KINDS and x[2] != "und"]
    assert sum(x[1] == x[2] for x in right) >= 0.95 * len(right)
    # A plain count of byte sequences of one text gives the same sums.
    w = model.machines["de", "en"][0]
    for t in ("Ein Éa..sch\tx", "a", rows[3][1]):
        folded = "".join(c if "a" <= c <= "z" or c > "\x7f" else " " for c in t.lower())
        b = f" {folded} ".encode()
        total = 0
        for n in (2, 3, 4):
            for k in range(len(b) - n + 1):
                g = b[k : k + n]
                if b"  " not in g:
                    h = n
                    for c in g:
                        h = ((h ^ c) * 0x9E3779B1) & 0xFFFFFFFF
                        h ^= h >> 15
                    total += int(w[h >> (32 - languages.BITS)])
        assert languages._sums(pa.array([t, "other"]), np.array([w]))[0][0, 0] == total


def test_few_languages(spark):
    out = languages.identify(table(spark, [(i, "some words", "en") for i in range(20)] + [(30, "12", "en")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("en", 1.0), ("und", 0.0)}
    out = languages.identify(table(spark, [(1, "words", None), (2, None, "en")])).collect()
    assert {r["lang_pred"] for r in out} == {"und"}
    assert languages.identify(table(spark, [])).count() == 0


def test_families():
    assert languages.family("en-US") == "germanic" and languages.family("pt_BR") == "romance" and languages.family("tlh") == "other"
    assert pytest.approx(1) == languages._counts("some text").sum()
