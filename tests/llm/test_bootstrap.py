"""The bootstrap of personal data against rounds in plain Python."""

import math
import random
from collections import defaultdict

from tallyrod.llm import pii


def plain_rounds(texts):
    """{(text's place, kind, start, end)} of accepted candidates."""
    found = {i: pii.instances(t, pii.base_spans(t)) for i, t in enumerate(texts)}
    seed = {}
    for xs in found.values():
        for x in xs:
            for p in x["patterns"]:
                seed[p, x["instance"]] = max(x["kind"], seed.get((p, x["instance"]), -1))
    known, accepted = defaultdict(set), {}
    for (_, x), k in seed.items():
        if k >= 0:
            known[x].add(k)
    while True:
        of = defaultdict(lambda: defaultdict(set))
        for p, x in seed:
            for k in known.get(x) or {-1}:
                of[p][k].add(x)
        good = {}
        for p, kinds in of.items():
            total = sum(map(len, kinds.values()))
            good |= {(p, k): len(xs) / total for k, xs in kinds.items() if k >= 0 and len(xs) >= pii.LEAST_KNOWN and len(xs) / total >= pii.LEAST_SHARE}
        miss = defaultdict(lambda: 1.0)
        for (p, x), k in seed.items():
            if k < 0:
                for (q, kind), share in good.items():
                    if p == q:
                        miss[x, kind] *= 1.000001 - share
        best = {}
        for (x, kind), m in miss.items():
            score = round(1 - m, 6)
            if score >= pii.LEAST_SCORE:
                best[x] = max(best.get(x, (-math.inf, 0)), (score, -kind))
        new = {x: -minus for x, (_, minus) in best.items() if x not in accepted}
        if not new:
            break
        accepted |= new
        seeds = defaultdict(set)
        for (_, x), k in seed.items():
            if k >= 0:
                seeds[x].add(k)
        known = defaultdict(set, {x: {max(ks)} for x, ks in seeds.items()})
        for x, k in accepted.items():
            known[x] = {max(k, *known[x])} if known[x] else {k}
    return {(i, accepted[x["instance"]], x["start"], x["end"]) for i, xs in found.items() for x in xs if x["kind"] < 0 and x["instance"] in accepted}


def test_spans_are_those_of_plain_rounds(spark):
    r = random.Random(12)
    texts = []
    for n in range(240):
        c = r.randrange(8)
        known = [f"u{r.randrange(40)}@example.com", f"10.0.{c}.{r.randrange(30)}", f"+1 555 01{r.randrange(10)} {r.randrange(1000, 1100)}"][c % 3]
        other = [f"user{r.randrange(12)}@intranet", f"00{r.randrange(60)}12345", f"555 0199 {r.randrange(1000, 1020)}"][r.randrange(3)]
        x = known if r.random() < [0.97, 0.9, 0.75, 0.3][c % 4] else other
        texts.append(f"note {n} left{c} mark{c} {x} right{r.randrange(2)} and so on")
    texts += [texts[3], "plain words only", "batch 20250101 is clean"]
    df = spark.createDataFrame([(i, t, "key") for i, t in enumerate(texts)], "doc_id long, text string, instance string").repartition(5)
    want = plain_rounds(texts)
    got = {(d["doc_id"], s["kind"], s["start"], s["end"]) for d in pii.detect(df).collect() for s in d["more"]}
    assert got == want and len(want) > 10
    for i, _, a, b in want:  # identifiers as planted, none in clean texts
        assert i < 241 and any(m in texts[i][a:b] for m in ("@intranet", "12345", "0199"))
