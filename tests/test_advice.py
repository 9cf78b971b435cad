"""Whole results where a plainer way would cut them."""

from tallyrod.plans import retrieval
from tallyrod.queries import FLAGSHIP, QUERIES


def test_retrieve_all_keeps_every_requirement(spark):
    docs = spark.createDataFrame([(1, "license license terms"), (2, "nothing")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("license", "3", True)], "keyword string, category string, is_specific boolean")
    reqs = spark.createDataFrame([(i, c, [f"k{i % 3}"], ["b", "a"]) for i in range(60) for c in ("3", "4") for _ in range(2)], "id long, category string, risks array<string>, mitigations array<string>")
    # Copies of a row come before the limit of three.
    incs = spark.createDataFrame([(i, "3", ["k9"]) for i in (1, 1, 1, 2, 3, 4)], "id long, category string, risks array<string>")
    none = {"signals": [], "strong": [], "category": "9"}
    bias = {"bias": ["terms"], "systemic": ["license"], "individual": ["person"], "drop": [], "systemic_adds": ["4"], "individual_adds": []}
    rows = retrieval.retrieve_all(docs, lexicon, ["license"], reqs, incs, none, bias).collect()
    of = lambda part, *cols: sorted(tuple(r[c] for c in cols) for r in rows if r["part"] == part)
    assert of("category", "doc", "category") == [(1, "3"), (1, "4")]
    assert of("requirement", "category", "id") == [(c, i) for c in ("3", "4") for i in range(60)]
    assert of("incident", "doc", "id", "place") == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    # A requirement of both categories counts once.
    assert of("risk", "category", "tf") == [("k0", 20), ("k1", 20), ("k2", 20), ("k9", 3)]
    assert of("mitigation", "category") == [("a",), ("b",)]
    assert FLAGSHIP == "retrieve_all" and FLAGSHIP in QUERIES
