"""The corpus pipeline stage by stage against plain Python on a small table."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tallyrod.llm import mixing, pii, quality_rules
from tests.llm.test_ngram_join import brute
from tests.llm.test_operators import base_by_patterns

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda: r.choice(["the", "of", "and", "a"]) if r.random() < 0.3 else "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    docs = []
    for i in range(30):
        text = [word() for _ in range(r.randint(55, 140))]
        if i % 4 == 0:
            text[10:10] = ["mail", f"ab.{i:02d}@mail{i % 9}.example.com"]
        docs.append((i, " ".join(text), "en", f"src{i % 3}"))
    docs += [(40 + i, docs[i][1] + " end", "en", "src1") for i in range(5)] + [(50, docs[2][1], "en", "src0"), (51, "too short", "en", "src0"), (52, None, "en", "src0"), (53, "x y z " * 40, "en", "src2"), (54, "", None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, docs


def test_pipeline(spark, folder):
    path, docs = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "pii", "mixing", "sentence_pieces"]
    kept = {r["doc_id"] for r in quality_rules.judge(spark.read.parquet(f"{path}/documents.parquet")).where("kept").select("doc_id").collect()}
    assert kept == {d[0] for d in docs} - {51, 52, 53, 54}
    left = [d for d in docs if d[0] in kept]
    stay = {i for i, _, c in brute([(d[0], d[1]) for d in left], 5, 80, 100) if i == c}
    cut = {d[0]: pii.cut(d[1], [(k, a, b) for a, k, b in base_by_patterns(d[1])]) for d in left if d[0] in stay}
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "pieces"]
    got = out.collect()
    # Whole rows, repeats counted: what the plan of the mixture says of the documents that are left.
    rows = [(d[0], cut[d[0]], d[2], d[3], len(d[1])) for d in left if d[0] in stay]
    plan = {r["doc_id"]: r["epochs"] + (2 * r["rest"] >= r["size"] > 0) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert Counter(tuple(r)[:5] for r in got) == Counter({x: plan[x[0]] for x in rows if plan[x[0]]})
    assert not any(re.search("@", r["text"]) for r in got) and any("[EMAIL]" in r["text"] for r in got)
    # Shares: 5, 2, 1 of one and a half times all words, at most twice a source's own, to within one document.
    size = {s: sum(len(t.split()) for i, t in cut.items() if dict((d[0], d[3]) for d in docs)[i] == s) for s in ("src0", "src1", "src2")}
    have = {s: sum(len(r["text"].split()) for r in got if r["source"] == s) for s in size}
    goal = 1.5 * sum(size.values())
    if 5 / 8 * goal > 2 * size["src0"]:
        want = {"src0": 2 * size["src0"]} | {s: min(2 * size[s], (goal - 2 * size["src0"]) * w / 3) for s, w in (("src1", 2), ("src2", 1))}
        for s, n in want.items():
            assert abs(have[s] - n) <= 160
    assert all(r["pieces"] for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
