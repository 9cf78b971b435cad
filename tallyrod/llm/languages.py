"""Language identification in two steps: the family first, then one-versus-one linear support vector machines in it.

A text is lower-cased; all ASCII but a-z counts as blank. Its features are the hashed sequences of 2, 3 and 4 bytes of its
UTF-8 (except those with two blanks in a row), as shares of their number. A machine parts two classes by the sign of
weights times features plus a bias. Machines between families vote on a text's family; machines between that family's
languages vote on the language. Weights are whole numbers, so a text's sums do not depend on how it is cut or batched.

Fitting takes a bounded sample of labelled rows: up to SAMPLE distinct texts a language, chosen by hash, each whole and
once more as a piece of PIECE bytes, so that short texts are met, too. For machines between families, a family's
languages share its SAMPLE evenly. A machine is fitted in a task of its own by dual coordinate descent, on at most 4 *
SAMPLE rows. The driver gets 64 KB a machine. Prediction is one pass over whole texts, with no shuffle.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is not learned from; rows of a null
language are not learned from; where nothing is learned all texts are `und`; where one language is learned it is
predicted with score 1; copies of a text count once a language; repeated rows get the same prediction; texts of any
length are read whole, piece by piece; an empty table gives an empty result; columns other than the named are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Distinct texts of a language, or of a family, from which a machine is fitted; bytes of a piece.
SAMPLE, PIECE = 400, 80
#: Features; lengths of byte sequences; passes over the rows; cost of a row on the wrong side; scale of weights.
BITS, LENGTHS, PASSES, COST, SCALE = 13, (2, 3, 4), 12, 10.0, 1 << 20
#: Bytes of text that are hashed at once.
_AT_ONCE = 1 << 20

#: Families of languages by their two-letter codes. Codes that are not listed are a family of their own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn ur pa mr gu ne si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.full(256, 32, "uint8")
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = _FOLD[ord("a") : ord("z") + 1]
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


def _features(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of folded bytes at which `length` of them start: the feature, and whether it counts."""
    n = max(len(x) - length + 1, 0)
    h = np.full(n, length, "uint32")
    ok = np.ones(n, bool)
    blank = x == 32
    two = blank[:-1] & blank[1:]
    for k in range(length):
        h = (h ^ x[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 < length:
            ok &= ~two[k : k + n]
    return h >> np.uint32(32 - BITS), ok


def _folded(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, starts of rows in them, first row): folded texts, each with a blank before and after, in pieces of about
    _AT_ONCE bytes. A row longer than that goes on in the next pieces, which begin again with its last three bytes."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    rows = pc.binary_join_element_wise(blank, lower, blank, none)
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    n = len(rows)
    offsets = np.frombuffer(rows.buffers()[1], "int64", n + 1, rows.offset * 8)
    data = np.frombuffer(rows.buffers()[2], "u1") if n else np.empty(0, "u1")
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _AT_ONCE, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[end])
        if b - a <= _AT_ONCE:
            yield _FOLD[data[a:b]], offsets[row:end] - a, row
        else:  # one long row: sequences that start before `at` are done
            for at in range(a, b, _AT_ONCE):
                yield _FOLD[data[at : min(b, at + _AT_ONCE + LENGTHS[-1] - 1)]], np.zeros(1, "int64"), row
        row = end


def _sums(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: sums of each row of weights over its features, and their number."""
    sums, counts = np.zeros((len(weights), len(texts)), "int64"), np.zeros(len(texts), "int64")
    for x, starts, row in _folded(texts):
        for length in LENGTHS:
            h, ok = _features(x, length)
            if len(starts) == 1 and len(x) > _AT_ONCE:  # the last bytes are the next piece's own
                ok[_AT_ONCE:] = False
            if not len(h):
                continue
            first = np.minimum(starts, len(h) - 1)
            to = slice(row, row + len(starts))
            counts[to] += np.add.reduceat(ok, first, dtype="int64")
            for k, w in enumerate(weights):
                sums[k, to] += np.add.reduceat(np.where(ok, w[h], 0), first, dtype="int64")
    return sums, counts


def _counts(text: str) -> np.ndarray:
    """Shares of the features of one text."""
    out = np.zeros(1 << BITS)
    for x, _, _ in _folded(pa.array([text])):
        for length in LENGTHS:
            h, ok = _features(x, length)
            if len(x) > _AT_ONCE:
                ok[_AT_ONCE:] = False
            out += np.bincount(h[ok], minlength=1 << BITS)
    return out / max(out.sum(), 1)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine: dual coordinate descent on the hinge loss, rows in a fixed
    order. y is 1 or -1. Features are scaled by the root of their mean, so that rare ones count."""
    scale = 1 / np.sqrt(x.mean(0, dtype="float64") + 1e-6)
    x *= scale.astype(x.dtype)  # in place: the rows are what a task holds most of
    norm = 1 + np.array([float(r @ r) for r in x])  # 1 for the bias
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(x))
    order = np.random.default_rng(5)
    for _ in range(PASSES):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w + bias) - 1) / norm[i], 0.0), COST)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w * scale, float(bias)


@dataclass
class Model:
    languages: list[str]
    #: (a, b): weights and bias; positive for a. Families are named with a leading blank.
    machines: dict[tuple[str, str], tuple[np.ndarray, int]] = field(default_factory=dict)

    def families(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.languages:
            out.setdefault(family(x), []).append(x)
        return out


def _labelled(docs: DataFrame, where: Column) -> DataFrame:
    return docs.where(where & F.col("lang").isNotNull() & _has_letter()).select(F.col("lang").cast("string").alias("lang"), "text")


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))


def sampled(docs: DataFrame, where: Column, sample: int = SAMPLE) -> DataFrame:
    """lang, key, place, text: up to `sample` distinct texts a language. First a share of them by a hash of the text, so
    that only these are shuffled; then the first by that hash."""
    rows = _labelled(docs, where).withColumn("key", F.xxhash64("text"))
    share = rows.groupBy("lang").agg((1.5 * (sample + 50) / F.approx_count_distinct("key", 0.02)).alias("share"))
    share = saved(share, "share").withColumnRenamed("lang", "l")  # one row a language
    some = rows.join(share, F.col("lang") == F.col("l")).where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    some = some.dropDuplicates(["lang", "key"])
    return some.select("lang", "key", F.row_number().over(W.partitionBy("lang").orderBy("key")).alias("place"), "text").where(F.col("place") <= sample)


def learn(docs: DataFrame, where: Column, sample: int = SAMPLE) -> Model:
    """The machines learned from the rows of docs (lang, text) for which `where` holds."""
    rows = saved(sampled(docs, where, sample), "sample")
    model = Model(sorted(r[0] for r in rows.select("lang").distinct().collect()))
    families = model.families()
    pairs = [(f" {a}", f" {b}") for a, b in itertools.combinations(sorted(families), 2)]
    pairs += [p for own in families.values() for p in itertools.combinations(sorted(own), 2)]
    if not pairs:
        return model
    spark = docs.sparkSession
    # (lang, side, machine, most): the machines that a language's rows go to, and how many of its rows.
    parts = [(x, s, k, sample if p[0][0] != " " else max(1, sample // len(families[family(x)]))) for k, p in enumerate(pairs) for s, name in ((1, p[0]), (-1, p[1])) for x in (families[name[1:]] if name[0] == " " else [name])]
    parts = spark.createDataFrame(parts, "l string, side int, machine int, most int")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "key"])
        cuts = [t.encode()[k % max(1, len(t.encode()) - PIECE) :][:PIECE].decode("utf-8", "ignore") for t, k in zip(pdf["text"], pdf["key"], strict=True)]
        x = np.empty((2 * len(pdf), 1 << BITS), "float32")
        for i, t in enumerate(itertools.chain(pdf["text"], cuts)):
            x[i] = _counts(t)
        w, bias = fit(x, np.tile(pdf["side"].to_numpy("float64"), 2))
        return pd.DataFrame({"machine": [int(pdf["machine"].iloc[0])], "weights": [np.rint(w * SCALE).astype("int64")], "bias": [round(bias * SCALE)]})

    own = rows.join(F.broadcast(parts), (F.col("lang") == F.col("l")) & (F.col("place") <= F.col("most")))
    for r in own.groupBy("machine").applyInPandas(fitted, "machine int, weights array<long>, bias long").collect():
        model.machines[pairs[r["machine"]]] = (np.array(r["weights"], "int64"), r["bias"])
    return model


def _margins(model: Model, texts: pa.Array, names: list[str]) -> dict[tuple[str, str], np.ndarray]:
    """Per machine between two of the names: bias plus mean weight of each text."""
    pairs = [p for p in itertools.combinations(names, 2) if p in model.machines]
    weights = np.array([model.machines[p][0] for p in pairs]).reshape(len(pairs), -1)
    sums, counts = _sums(texts, weights)
    return {p: (s / np.maximum(counts, 1) + model.machines[p][1]) / SCALE for p, s in zip(pairs, sums, strict=True)}


def _voted(model: Model, texts: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The place in `names` of each text's winner, and its mean share of votes. Votes are soft: the logistic of the margin."""
    if len(names) == 1:
        return np.zeros(len(texts), "int64"), np.ones(len(texts))
    votes = np.zeros((len(names), len(texts)))
    for (a, b), m in _margins(model, texts, names).items():
        share = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
        votes[names.index(a)] += share
        votes[names.index(b)] += 1 - share
    return votes.argmax(0), votes.max(0) / (len(names) - 1)


def classify(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score: the family's mean vote times the language's in the family."""
    families = model.families()
    names = sorted(families)
    which, score = _voted(model, texts, [f" {x}" for x in names] if len(names) > 1 else names)
    out = [""] * len(texts)
    for k, name in enumerate(names):
        rows = np.flatnonzero(which == k)
        if len(rows):
            own = sorted(families[name])
            inside, share = _voted(model, texts.take(pa.array(rows)), own)
            score[rows] *= share
            for r, i in zip(rows.tolist(), inside.tolist(), strict=True):
                out[r] = own[i]
    return out, score


def predict(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """The columns to keep, lang_pred and score (rounded to 6 digits) of each whole text."""
    own = docs.select(*keep, _has_letter().alias("__letter"), "text")
    names = own.columns[: len(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letter = b.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
            langs, scores = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            rows = np.flatnonzero(letter)
            if len(rows) and model.languages:
                found, score = classify(model, b.column("text").take(pa.array(rows)))
                langs[rows], scores[rows] = found, np.round(score, 6)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    return own.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Remainder 0 of crc32 by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out, predicted for all."""
    out = held_out(F.col("doc_id"))
    return predict(docs, learn(docs, ~out, sample), [F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out")])
