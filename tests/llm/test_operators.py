"""The operators of training-data pipelines on small tables with nulls, blanks, ties, repeated rows, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrod.llm import kneser_ney, mixing, pii, quality_rules, revisits, sentence_pieces, token_files, topk, url_filter

tokenizers_files = pytest.importorskip("public_tokenizers")

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \t\n", "one", "The cat sat on the mat.\nThe cat sat on the mat.\n\nÉté, the\x0bend", "x" * 3000, "a b c " * 400, "naïve café ünïcode 中文 字", "don't   stop\r\n now", "The cat sat on the mat.\nThe cat sat on the mat.\n\nÉté, the\x0bend"]


def docs_of(spark, texts=TEXTS, n=2):
    """doc_id with a null and a repeated row, sources with a null, extra columns with names that operators use."""
    rows = [(None if i == 3 else i, t, [None, "a", "b"][i % 3], "key", 1.0, i) for i, t in enumerate(texts)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size double, metrics int").repartition(n)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


# Quality rules


def quality_counts(t):
    t = t or ""
    w = SPACE.findall(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics(spark):
    texts = [*TEXTS, "a b c a b c a", "# * | <>\n# * | <>", "x y x y x y"]
    got = quality_rules.judge(docs_of(spark, texts).drop("metrics")).select("text", "metrics.*", "base_failed", "kept").collect()
    for r in got:
        n = quality_counts(r["text"])
        assert tuple(r[1:6]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_keeps_prose_and_columns(spark):
    r = random.Random(1)
    prose = " ".join(r.choice("the of and a cat dog tree house walks quickly under over green bright morning".split()) + r.choice(["", "", ","]) + str(i % 7) * (i % 9 == 0) for i in range(300))
    df = spark.createDataFrame([(1, prose, 5), (2, "buy!! " * 80, 6), (3, prose.upper(), 7)], "doc_id long, text string, extra int")
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and [x["doc_id"] for x in kept.collect()] == [1]


# Mixing


def test_mixing_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 5, 60, 300]))) or None, r.choice(["s0", "s0", "s0", "s1", "s2", None])) for i in range(150)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for g in got:
        sizes[g["source"]] += g["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    while True:  # hand out by weight, fix what is above its cap, and again
        free = [s for s in names if s not in target]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
    taken = defaultdict(int)
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and g["target"] == pytest.approx(target[g["source"]])
        assert 0 <= g["taken"] <= 2 * g["size"] and g["taken"] >= g["epochs"] * g["size"]
        taken[g["source"]] += g["taken"]
    for s in names:
        assert taken[s] == round(target[s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    out = mixing.copies(df)
    assert out.columns == df.columns and out.where("doc_id is null").count() == 0
    assert mixing.mix(empty(spark)).count() == 0


# Token files


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    texts = [*TEXTS, "<|endoftext|> x", "it's a  b\n c's"]
    df = docs_of(spark, texts)
    got = token_files.round_trip(df, path).collect()
    model = Tokenizer.from_file(path)
    ids = {t: [*model.encode(t or "", add_special_tokens=False).ids, 0] for t in set(texts)}
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    at, want = 0, []
    for d, t in rows:
        want.append((d, at, len(ids[t]), zlib.crc32(np.asarray(ids[t], "<u4").tobytes())))
        at += len(ids[t])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_files.round_trip(empty(spark), path).count() == 0


def test_token_files_are_pruned_by_id(spark, tmp_path):
    path = token_files.write(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text")), f"file://{tmp_path}/t", tokenizers_files.path("byte_bpe_50k.json"), files=3)
    import pyarrow.orc as orc

    files = sorted((tmp_path / "t/data").glob("*.orc"))
    held = [orc.ORCFile(f).read(columns=["doc_id"]).column(0).to_pylist() for f in files]
    assert sorted(x for h in held for x in h) == list(range(2000)) and all(a[-1] < b[0] for a, b in zip(held, held[1:], strict=False))  # no two files share a range
    for f in files:
        raw = f.read_bytes()
        assert raw.count(b"ORC") and orc.ORCFile(f).nstripes >= 1
    one = token_files.read(spark, path).where("doc_id = 77")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)" in one._jdf.queryExecution().toString().replace("IsNotNull(file), ", "")


def test_encoder_cuts_where_no_token_crosses():
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    model, r = Tokenizer.from_file(path), random.Random(4)
    letters = ["a", "b", " ", "\n", "5", "'", "s", ".", "é", "ж", "\t", "中", "²", "-", "!", "<|endoftext|>", "́", "\x85", "\xa0"]
    texts = ["".join(r.choice(letters[: r.choice([5, 9, 19])]) for _ in range(r.randint(0, 14))) for _ in range(20000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert token_files.encoded(texts, path) == want


@pytest.mark.parametrize("sizes", [{"MEMORY": 500}, {"SLOTS": 256}, {"PROBES": 1}, {"MEMORY": 500, "SLOTS": 256, "PROBES": 2}, {"AT_ONCE": 30}])
def test_encoder_forgets_and_overflows(monkeypatch, sizes):
    from tokenizers import Tokenizer

    path = tokenizers_files.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "_models", {})
    for k, v in sizes.items():
        monkeypatch.setattr(token_files, k, v)
    model, r = Tokenizer.from_file(path), random.Random(7)
    letters = ["a", "b", " ", "\n", "5", "'", "s", ".", "é", "ж", "×", "ſ", "\0", "\x1c", "\u2003", "\u3000", "中", "ab" * 9]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(1000)] * 2
    want = [np.asarray(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 50) for x in token_files.encoded(texts[i : i + 50], path)] == want
    assert token_files.encoded(["\n".join(texts)], path) == [np.asarray(model.encode("\n".join(texts), add_special_tokens=False).ids, "<u4").tobytes()]
    assert "MEMORY" not in sizes or token_files.memory(path).n < 2500  # of more than 8,000


def test_encoder_remembers_a_million_words(monkeypatch):
    path = tokenizers_files.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "_models", {})
    blocks = [[" ".join(np.base_repr(i * 7919 % 1_000_003, 5).translate(str.maketrans("01234", "etaon")) for i in range(at, at + 10_000))] for at in range(0, 1_000_000, 10_000)]
    first = [token_files.encoded(b, path) for b in blocks]
    memory, calls = token_files.memory(path), []
    monkeypatch.setattr(memory, "model", lambda *a, **k: calls.append(a))
    assert [token_files.encoded(b, path) for b in blocks] == first and not calls


# Language model


def test_kneser_ney_against_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", *(" ".join(r.choice(["The", "the", "cat", "dog", "ran", "é", "zz" + str(r.randint(0, 30))]) for _ in range(r.randint(1, 40))) for _ in range(80))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = {x["doc_id"]: x for x in kneser_ney.score_held_out(df).collect()}
    words = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in enumerate(texts)}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    c, bi = Counter(), Counter()
    for i in train:
        c.update(words[i])
        bi.update(zip([b"\t", *words[i][:-1]], words[i], strict=True))
    n, v, context, after, cont = sum(c.values()), len(c), Counter(), defaultdict(Counter), Counter()
    for (a, b), k in bi.items():
        context[a] += k
        after[a][min(k, 3)] += 1
        cont[b] += 1
    count_of = lambda xs: [sum(x == i for x in xs) for i in (1, 2, 3, 4)]
    d, e = [0, *kneser_ney.discounts(count_of(bi.values()))], [0, *kneser_ney.discounts(count_of(cont.values()))]
    left = sum(e[min(x, 3)] for x in cont.values()) / len(bi)
    uni = lambda w: max(cont[w] - e[min(cont[w], 3)], 0) / len(bi) + left / (v + 1)
    p = lambda a, w: uni(w) if a not in context else max(bi[a, w] - d[min(bi[a, w], 3)], 0) / context[a] + sum(d[j] * after[a][j] for j in (1, 2, 3)) / context[a] * uni(w)
    for i, ws in words.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (i not in train, len(ws), sum(c[w] > 0 for w in ws), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert g["score"] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([b"\t", *ws[:-1]], ws, strict=True)))
    for a in [b"\t", b"the", b"unseen"]:  # all known words and one unknown one
        assert sum(p(a, w) for w in c) + p(a, b"?") == pytest.approx(1)


def test_kneser_ney_of_nothing(spark):
    assert kneser_ney.score_held_out(empty(spark)).count() == 0
    one = kneser_ney.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), kneser_ney.train(empty(spark))).first()
    assert one["n_tokens"] == 3 and one["score"] == 0.0


# SentencePiece


def test_pieces_are_the_best_segmentation(spark):
    path = tokenizers_files.path("piece_bpe_32k.model")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    score = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
    longest, unknown = max(map(len, score)), min(s for _, s in score.values()) - 10
    mine, r = sentence_pieces.Pieces(path), random.Random(6)
    texts = ["".join(r.choice("aeinrst  the\n中é▁😀") for _ in range(r.randint(0, 25))) for _ in range(400)]
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        s = sentence_pieces.MARK + t.replace(" ", sentence_pieces.MARK) if t else ""
        best = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            best[j] = best[j - 1] + unknown
            for i in range(max(0, j - longest), j):
                if s[i:j] in score:
                    best[j] = max(best[j], best[i] + score[s[i:j]][1])
        got, k = 0.0, 0
        ids = np.frombuffer(ids, "<i4").tolist()
        while k < len(ids):
            p = proto.pieces[ids[k]]
            if p.type == 6:
                lead = int(p.piece[3:5], 16)
                got, k = got + unknown, k + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            else:
                got, k = got + p.score, k + 1
        assert got == pytest.approx(best[-1]), t
        assert mine.decode(ids) == t.replace("▁", " ")


def test_pieces_of_a_table(spark):
    path = tokenizers_files.path("piece_bpe_32k.model")
    df = docs_of(spark)
    both = sentence_pieces.decode(sentence_pieces.encode(df, path), path)
    assert both.columns == [*df.columns, "pieces", "decoded"]
    assert all(r["decoded"] == r["text"] for r in both.collect())
    assert {r["same"] for r in sentence_pieces.digests(df, path).collect()} == {True, None}
    assert sentence_pieces.digests(empty(spark), path).count() == 0


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_patterns(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15])


def test_base_spans_against_the_patterns():
    r = random.Random(7)
    for _ in range(20000):
        t = "".join(r.choice("a1.@+-( )94 ") for _ in range(r.randint(0, 40)))
        assert [(a, k, b) for k, a, b in pii.base_spans(t)] == base_by_patterns(t), t
    assert len(pii.base_spans("9" * 200_000 + "." * 100_000 + "a" * 200_000 + "@")) == 0


def test_contexts_find_unseen_identifiers(spark):
    seen = [f"please call me at +1 (555) 010-{1000 + i} before noon" for i in range(8)]
    rows = [(i, t) for i, t in enumerate([*seen, "please call me at 555-0102-777 before noon", "version 12345678 is clean here", None, ""])]
    df = spark.createDataFrame([*rows, rows[8]], "doc_id long, text string")
    got = [(r["doc_id"], r["spans"], r["base_sha256"], r["n_phone"]) for r in pii.report(df).collect()]
    start = rows[8][1].index("555")
    assert [s for d, s, _, _ in got if d == 8] == [f"phone:{start}:{start + 12}"] * 2
    assert {s for d, s, _, _ in got if d in (9, 10, 11)} == {""}
    for d, s, h, n in got:
        if d is not None and d < 8:
            assert n == 1 and h == hashlib.sha256(s.encode()).hexdigest()
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[8] == "please call me at [PHONE] before noon" and out[0] == out[8] and out[9] == rows[9][1] and out[10] is None
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Top-k, URL filter, revisits


def test_top_k_with_one_vector_of_large_components(spark):
    # Largest score with another row is far below 2**63, though the largest components of all rows would pass it.
    r = np.random.default_rng(3)
    vec = [list(map(float, r.standard_normal(64))) for _ in range(200)] + [[1e14, *[0.0] * 63], [*[0.0] * 63, 1e14]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vec)], "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(df, F.col("vec_id") >= 199, k=3).collect()}
    q = [[math.floor(64 * x) for x in v] for v in vec]
    for i in (199, 200, 201):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in range(len(q)) if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [(j, -s) for s, j in best]
    with pytest.raises(Exception, match="passes 2"):
        topk.top_k(df.unionByName(df.where("vec_id = 200").withColumn("vec_id", F.lit(300).cast("long"))), F.col("vec_id") == 200, k=3).collect()


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "PILOT", 40)  # a part of the rows
    r = np.random.default_rng(8)
    base = r.standard_normal((12, 16))
    vec = [list(map(float, base[r.integers(12)] + 0.1 * r.standard_normal(16))) for _ in range(700)]
    vec[50] = vec[40] = vec[20]
    rows = [(i, v, 0) for i, v in enumerate(vec)] + [(700, None, 0), (720, [1.0] * 15 + [None], 0), (740, [float("nan")] * 16, 0), (760, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = defaultdict(list)
    for x in topk.top_k(df, F.col("vec_id") % 20 == 0, group=150).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    q = np.floor(64 * np.asarray(vec)).astype("int64")
    s = q @ q.T
    assert set(got) == set(range(0, 700, 20))
    for i in got:
        want = sorted(((j, int(s[i, j])) for j in range(700) if j != i), key=lambda x: (-x[1], x[0]))[:20]
        assert got[i] == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(few.where("false"), F.lit(True)).count() == 0


def test_url_filter(spark):
    urls = ["http://Example.NET/en/x?y", "https://a.example.net/en", "https://a.example.net/fr/", "http://x.example.com/de/1", "http://example.com/DE/", "ftp://b.org/fr/", "http://cheap-pills.example.com/a/?utm_source=q&z=1#t", None, "no scheme", "http://notexample.com/de/", "http://"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(6, urls[6], "x")], "page_id long, url string, block string")
    got = sorted({(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.listing(df)).collect()})
    assert got == [
        (0, "example.net", "/en/x", "example.net/en/", "allow"), (1, "a.example.net", "/en", "net/", "block"), (2, "a.example.net", "/fr/", "net/", "block"), (3, "x.example.com", "/de/1", "example.com/de/", "block"), (4, "example.com", "/DE/", None, "allow"),
        (5, "b.org", "/fr/", "org/fr/", "allow"), (6, "cheap-pills.example.com", "/a/", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "notexample.com", "/de/", None, "allow"), (10, "", "", None, "allow"),
    ]
    assert url_filter.judge(df.where("false"), url_filter.listing(df)).count() == 0


def test_filter_members_are_exact(spark):
    listed = spark.range(500).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    df = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("u"), F.col("id").cast("string"))).alias("u"), "id")
    got = {r["id"] for r in url_filter.member(df, "u", listed).where("listed").collect()}
    assert got == {i for i in range(500) if i % 7 > 0}


def test_revisits_against_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(400):
        status = r.choice([200, 304, 304, 404])
        h = {"etag": r.choice(['"a"', 'W/"a"', '"b"'])} if r.random() < 0.7 else {"last-modified": r.choice(["x", "y"])} if r.random() < 0.8 else {}
        h |= {"date": str(i), "content-length": str(i)}
        rows.append((i, r.choice(["http://h/a", "https://www.h/a/#f", "http://h/b", None]), r.choice([None, *range(0, 400_000, 9_000)]), status, h, f"d{i}" if status == 200 and r.random() < 0.9 else None, i, "extra"))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string, n_bytes long, period string")
    got = {x["record_id"]: x for x in revisits.resolve(df).collect()}
    key = lambda u: None if u is None else u.split("/")[-1] if u.endswith("b") else "a"
    assert set(got) == {x[0] for x in rows if x[3] == 304}
    for x in rows:
        if x[3] != 304:
            continue
        able = [y for y in rows if y[3] == 200 and y[5] and y[1] and x[1] and key(y[1]) == key(x[1]) and x[2] is not None and y[2] is not None and (y[2], y[0]) < (x[2], x[0])]
        g = got[x[0]]
        if not able:
            assert g["verdict"] == "unmatched" and g["response_id"] is None
            continue
        best = max(able, key=lambda y: (y[2], y[0]))
        bare = lambda e: e and e.removeprefix("W/")
        ok = bare(x[4].get("etag")) == bare(best[4].get("etag")) if "etag" in x[4] else x[4]["last-modified"] == best[4].get("last-modified") if "last-modified" in x[4] else None
        assert g["response_id"] == best[0] and g["digest"] == best[5] and g["verdict"] == {None: "unchecked", True: "resolved", False: "mismatch"}[ok]
        if ok:
            assert g["merged"] == best[4] | {k: v for k, v in x[4].items() if k in revisits.RENEWED}
    assert revisits.resolve(df.where("false")).count() == 0


def test_words_are_hashed_as_split(monkeypatch):
    import pyarrow as pa

    from tallyrod.llm import common

    r, known = random.Random(3), {}
    for _ in range(300):
        monkeypatch.setattr(common, "_PIECE", r.choice([3, 7, 64, 1000]))
        texts = [r.choice([None, "", "".join(r.choice("aB é\n中 \x0bz") for _ in range(r.randint(0, 60)))]) for _ in range(r.randint(0, 8))]
        hashes, counts = common.hashed_words(pa.array(["x", *texts], pa.string()).slice(1))
        ws = [common.words_of(t) for t in texts]
        assert counts.tolist() == list(map(len, ws))
        for w, h in zip([w for x in ws for w in x], hashes.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_clashing_columns(spark):
    prose = " ".join("the of and a cat dog tree house walks quickly under over".split()[i * i % 11] + str(i % 13) * (i % 3 == 0) for i in range(150))
    df = spark.createDataFrame([(1, prose, 5, 6, 7, 8, "p", "l", "u"), (2, "no", 5, 6, 7, 8, "p", "l", "u")], "doc_id long, text string, metrics int, kept int, broken int, base_failed int, pieces string, listed string, host string")
    judged = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert judged[1]["metrics"]["n_words"] == 150 and not judged[2]["kept"] and judged[2]["pieces"] == "p"
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in df.where("doc_id = 1").collect()] * int(judged[1]["kept"])
    path = tokenizers_files.path("piece_bpe_32k.model")
    coded = sentence_pieces.encode(df, path)
    assert coded.columns == [*(c for c in df.columns if c != "pieces"), "pieces"]
    assert {r["text"] for r in sentence_pieces.decode(coded.drop("text").withColumnRenamed("host", "text"), path, into="text").collect()} == {prose, "no"}
    pages = spark.createDataFrame([(1, "http://a.net/x", "h", 3, "v", "l", 9)], "page_id long, url string, host string, path int, verdict string, listed string, block int")
    (r,) = url_filter.judge(pages, url_filter.listing(pages)).collect()
    assert (r["host"], r["path"], r["verdict"], r["listed"], r["block"]) == ("a.net", "/x", "block", False, 9)
    (r,) = url_filter.judge(pages.select("page_id", F.col("url").alias("host")), url_filter.listing(pages), url="host").collect()
    assert (r["host"], r["path"]) == ("a.net", "/x")


def test_top_k_of_large_values_and_of_equal_vectors(spark):
    rows = [(i, [(96000001 + 2 * i) / 64, (150000003 + 2 * i) / 64]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    of = lambda i, j: (96000001 + 2 * i) * (96000001 + 2 * j) + (150000003 + 2 * i) * (150000003 + 2 * j)
    for q in (0, 20, 40, 60):
        want = sorted(((-of(q, j), j) for j in range(80) if j != q))[:20]
        assert [got[q, k] for k in range(1, 21)] == [(j, -s) for s, j in want]
    same = spark.range(10_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(-2.0)).alias("embedding"))
    got = topk.top_k(same, F.col("vec_id").isin(0, 9_980), group=1_500).groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("v")).collect()
    assert {r["query_id"]: r["v"] for r in got} == {0: list(range(1, 21)), 9_980: list(range(20))}
    with pytest.raises(Exception, match="2\\*\\*63"):
        topk.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_top_k_of_repeated_rows_and_ids(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 60), [float(r.randint(-2, 2)) for _ in range(3)]) for _ in range(160)]
    rows += [(7, [1.0, 1.0, 1.0])] * 30 + [(40, [2.0, 2.0, 2.0])] * 25 + [(20, [1.0, 0.0, -1.0]), (20, [1.0])]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for x in topk.top_k(df, F.col("vec_id") % 20 == 0, group=30).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((-x["score"], x["vec_id"]))
    asks = {i: {tuple(v) for j, v in rows if j == i} for i, _ in rows if i % 20 == 0}
    assert set(got) == set(asks)
    for i, vs in asks.items():  # an id with several vectors asks with each
        assert got[i] == sorted((-4096 * int(sum(a * b for a, b in zip(q, v, strict=False))), j) for q in vs for j, v in rows if j != i)[:20]
