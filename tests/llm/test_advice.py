"""Whole results where a plainer way would cut them."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict

from tallyrod.llm import mixing, ngram_join, pii

LONG = [f"w{i}" for i in range(60)]
TEXT, NEAR, OTHER = " ".join(LONG), " ".join([*LONG[:-1], "z"]), " ".join(f"v{i}" for i in range(60))


def test_one_each_where_ids_repeat_or_lack(spark):
    # Two texts of one id that are not linked, one of which has a near copy of lesser id; copies without an id.
    docs = [(1, NEAR, 0), (4, TEXT, 1), (4, OTHER, 2), (6, "", 3), (6, None, 4), *((None, "a b c d e f g", 5 + i) for i in range(5))]
    df = spark.createDataFrame(docs, "doc_id long, text string, n int")
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_each(df).collect()]
    assert sorted(got, key=str) == sorted([(1, NEAR), (4, OTHER), (6, ""), (6, None), (None, "a b c d e f g")], key=str)


def test_classes_without_an_id_link_others(spark):
    df = spark.createDataFrame([(None, TEXT), (3, NEAR), (None, NEAR), (None, OTHER)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_each(df).collect()]
    assert sorted(got, key=str) == sorted([(3, NEAR), (None, OTHER)], key=str)


def test_candidates_and_contexts_of_identifiers():
    def found(t):
        return {x["instance"]: x["patterns"] for x in pii.instances(t, pii.base_spans(t)) if x["kind"] < 0}

    for x in ("bob(at)host", "anna.lee@intranet", "(555) 123-4567", "555 123 4567", "4111 1111 1111 1112"):
        assert "mail me _" in found(f"please mail me {x} or not")[x]
    for t in ("please mail me <bob@example.com>, or", 'please mail me ( "bob@example.com" , or'):
        (x,) = pii.instances(t, pii.base_spans(t))
        assert x["patterns"] == ["mail me _", "me _ or"]
    assert not found("an @ alone and @user and 12 34")


def test_rounds_go_on_until_nothing_is_new(spark):
    # In a context 18 of 22 are known, and 20, which is enough, once those of the level before are.
    docs = []
    for level in range(1, 7):
        before = ["v0@example.com", "v1@example.com"] if level == 1 else [f"user{k}@intranet{level - 1}" for k in range(2)]
        for x in [*(f"u{k}@example.com" for k in range(18)), *before, *(f"user{k}@intranet{level}" for k in range(2))]:
            docs.append((len(docs), f"write to ctx{level} {x} soon{len(docs)}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sum(len(r["more"]) for r in pii.detect(df).collect()) == 22


def test_scan_takes_time_in_proportion_to_a_text():
    n = 1_000_000
    for unit in ("1", " ", ".", "-", "(", "a", "@", "+", "1 ", "1.", "1-", "+1", "(1", "a@", "a.", "@1", "é"):
        for tail in ("", " a@b.c 1.2.3.4 +1 555 010 1234"):
            t, start = unit * (n // len(unit)) + tail, time.process_time()
            pii.instances(t, pii.base_spans(t))
            assert time.process_time() - start < 6, unit  # 13.6 s for 20,000 digits before


def test_linear_runs_are_those_of_the_plain_pattern():
    plain, r = re.compile(r"\+?\(?[0-9]+(?:[\x20.()-]{1,3}[0-9]+)+"), random.Random(4)
    for _ in range(20_000):
        t = "".join(r.choice("01 .()-+x") for _ in range(r.randint(0, 24)))
        assert [m.span() for m in plain.finditer(t)] == [m.span() for m in pii._RUN.finditer(t)]


def test_copies_follow_the_plan_where_rows_and_ids_repeat(spark):
    r = random.Random(9)
    docs = [(i, " ".join(f"w{r.randint(0, 40)}" for _ in range(r.randint(1, 30))), r.choice("abbcc"), i) for i in range(60)]
    docs += [(1, "the same id in another source", "b", 7), (1, "the same id in another source", "a", 7), (2, docs[2][1], docs[2][2], 99), *[docs[3]] * 25, *[(None, "no id x y", "c", 0)] * 40, (None, None, "c", 1), (5, "", None, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    got = Counter(map(tuple, mixing.copies(df).collect()))
    plan = defaultdict(lambda: [0, 0])  # by id, source, size: rows and their copies
    for p in mixing.mix(df).collect():
        x = plan[p["doc_id"], p["source"], p["size"]]
        x[0] += 1
        x[1] += 1 if p["size"] == 0 else p["epochs"] + (0 < p["size"] <= 2 * p["rest"])
    have = Counter()
    for (i, t, s, _), n in got.items():
        have[i, s, len((t or "").split())] += n
    assert dict(have) == {k: c for k, (_, c) in plan.items() if c}
    for k, rows in itertools.groupby(sorted(set(docs), key=str), key=lambda d: (d[0], d[2], len((d[1] or "").split()))):
        rows = list(rows)
        each = plan[k][1] / plan[k][0]
        assert all(abs(got[d] - each * docs.count(d)) < docs.count(d) or len(rows) > 1 for d in rows)
    words, target = Counter(), {}
    for (_, t, s, _), n in got.items():
        words[s] += n * len((t or "").split())
    for p in mixing.mix(df).select("source", "target").distinct().collect():
        assert abs(words[p["source"]] - p["target"]) <= 30
