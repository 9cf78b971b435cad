"""A bigram model with interpolated modified Kneser-Ney smoothing (Chen and Goodman 1999), counted in Spark, stored as
sorted hash arrays that workers map into memory.

The vocabulary is a sorted array of 64-bit word hashes; a word's place in it is its number, and the arrays of counts
run by that number. Bigrams (first << 32 | second) are sorted arrays cut into shards by a hash of the bigram, so no
frequent word fills one shard. All counts are summed inside tasks before they are shuffled, as packed arrays, and held
in 64 bits; shards of bigrams grow in number with the corpus, those of words with the session's shuffle partitions.

    p(w | v) = max(c(vw) - D(c), 0) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v) * p(w)
    p(w)     = max(cont(w) - E(cont), 0) / N + (E1 M1 + E2 M2 + E3 M3+) / N / (V + 1)

cont(w): distinct words before w; N: distinct bigrams; V: distinct training tokens; D and E from the counts of counts.
The sum over known words and one unknown word is 1 after any context.

Defined cases: a null text is empty and has one token, its end; with no training text every token has p = 1 / (V + 1)
= 1; repeated rows count each time; an id that is null counts as the text "null" when training is chosen; only doc_id
and text are read. The model holds up to 2**31 distinct words, beyond which it stops with an error.
"""

from __future__ import annotations

import math
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, saved, shared_dir

#: Hashes that stand for the end of a text (a token) and its start (a context only).
END, START = 1, 0
#: Texts that are hashed, or scored, at once.
ROWS = 1_000
#: Tokens gathered in a task before they are counted and packed.
GATHERED = 1_500_000
#: Bigrams, or words, in one shard.
SHARD = 1_500_000

#: Arrays by word number: count as a token, count as a context, distinct bigrams after it counted once, twice, more
#: often, distinct words before it.
KINDS = ("count", "context", "n1", "n2", "n3", "cont")

_models: dict = {}


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words, then END, text after text; and each text's number of tokens."""
    h, n = hashed_words(texts)
    return np.insert(np.maximum(h, np.uint64(2)), np.cumsum(n), np.uint64(END)), n + 1


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(folds)) == F.lit(fold)


_COUNTED = ["shard", "data", "file", "n", "c1", "c2", "c3", "c4"]

# Packed rows: (shard, keys, values ...), keys sorted uint64, values one little-endian array each.


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of each value."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[at], *(np.add.reduceat(v[order], at) for v in values)]


def _spread(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _range(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards by range of 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _pack(keys: np.ndarray, values: list[np.ndarray], shard: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row a shard with its keys, which stay sorted, and values."""
    order = np.argsort(shard, kind="stable")
    keys, values = keys[order], [v[order] for v in values]
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    some = [k for k in range(shards) if ends[k] < ends[k + 1]]
    # Keys as steps, which are small where keys are dense.
    data = [_bytes([np.diff(keys[a:b], prepend=np.uint64(0)), *(v[a:b] for v in values)]) for a, b in ((ends[k], ends[k + 1]) for k in some)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])


def _bytes(arrays: list[np.ndarray]) -> bytes:
    """Each array by byte planes, so that the many zero bytes compress, as one zstandard frame."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(x.astype("<u8").view("u1").reshape(n, 8).T) for x in arrays]
    return n.to_bytes(8, "little") + bytes([len(planes)]) + bytes(pa.compress(b"".join(p.tobytes() for p in planes), codec="zstd"))


def _arrays(data: bytes) -> list[np.ndarray]:
    n, k = int.from_bytes(data[:8], "little"), data[8]
    raw = np.frombuffer(pa.decompress(data[9:], decompressed_size=8 * n * k, codec="zstd"), "u1").reshape(k, 8, n)
    keys, *values = (np.ascontiguousarray(x.T).view("<u8").reshape(n) for x in raw)
    return [np.cumsum(keys, dtype="uint64"), *values]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sums of each shard; rows come sorted by shard, and parts are added up when they are many."""
    now, parts, held = None, [], 0
    for b in batches:
        for shard, data in zip(b.column("shard").to_pylist(), b.column("data"), strict=True):
            if shard != now and parts:
                yield now, _summed(*map(np.concatenate, zip(*parts, strict=True)))
                parts, held = [], 0
            now = shard
            parts.append(_arrays(data.as_py()))
            held += len(parts[-1][0])
            if held > 4 * SHARD:
                parts = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
                held = len(parts[0][0])
    if parts:
        yield now, _summed(*map(np.concatenate, zip(*parts, strict=True)))


def _dealt(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartition(parts, "shard").sortWithinPartitions("shard")


# Model files: below one folder, which all workers can open. A file is written under another name and then renamed, so
# a task that runs twice leaves one whole file.


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _put(folder: str, name: str, array: np.ndarray) -> None:
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with system.open_output_stream(own) as f:
        f.write(np.ascontiguousarray(array).tobytes())
    system.move(own, f"{path}/{name}")


def _map(folder: str, name: str, kind: str) -> np.ndarray:
    """The array, mapped; from a store that isn't a local folder it is copied once to this machine. Copies are named by a
    digest of the whole path and lie in the folder that the resource manager gives Spark for its own files and removes with
    them (the worker's temporary folder where none is named)."""
    system, path = _open(f"{folder}/{name}")
    if not isinstance(system, fs.LocalFileSystem):
        import tempfile

        own = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or tempfile.gettempdir()
        local = f"{own.split(',')[0]}/{hashlib.sha256(path.encode()).hexdigest()}"
        if not os.path.exists(local):
            with system.open_input_stream(path) as f, open(f"{local}.{os.getpid()}", "wb") as g:
                while data := f.read(1 << 24):
                    g.write(data)
            os.replace(f"{local}.{os.getpid()}", local)
        path = local
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


class Words:
    """The vocabulary: shards of sorted hashes by range, which makes them one sorted array."""

    def __init__(self, folder: str, shards: list[tuple[int, int]], n_shards: int):
        self.n_shards, self.first, self.files = n_shards, np.zeros(n_shards + 1, "int64"), {}
        sizes = np.zeros(n_shards, "int64")
        for k, n in shards:
            sizes[k] = n
            self.files[k] = _map(folder, f"words-{k}", "<u8")
        self.first[1:] = np.cumsum(sizes)

    def number(self, h: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 if unknown."""
        distinct, back = np.unique(h, return_inverse=True)
        out = np.full(len(distinct), -1, "int64")
        shard = _range(distinct, self.n_shards)
        for k in np.unique(shard).tolist():
            words = self.files.get(int(k))
            if words is not None:
                a, b = np.searchsorted(shard, [k, k + 1])
                at = np.searchsorted(words, distinct[a:b])
                near = np.minimum(at, len(words) - 1)
                out[a:b] = np.where(words[near] == distinct[a:b], near + self.first[int(k)], -1)
        return out[back]


class Model:
    """What a worker maps: vocabulary, counts by word number, bigram shards."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.words = Words(spec["folder"], spec["words"], spec["word_shards"])
        shards = [*spec["words"], (spec["word_shards"], 1)] if spec["distinct"] else []  # the last one is START's
        self.by_word = {k: [_map(spec["folder"], f"{k}-{s}", "<u8") for s, _ in shards] for k in KINDS}
        self.places = np.asarray([self.words.first[s] for s, _ in shards], "int64")
        self.keys = {s: _map(spec["folder"], f"bigrams-{s}", "<u8") for s in spec["bigrams"]}
        self.counts = {s: _map(spec["folder"], f"bigram_counts-{s}", "<u8") for s in spec["bigrams"]}

    def of(self, kind: str, number: np.ndarray) -> np.ndarray:
        """That count of sorted distinct word numbers, 0 for -1."""
        out = np.zeros(len(number), "int64")
        ends = np.append(np.searchsorted(number, self.places), len(number))
        for i, part in enumerate(self.by_word[kind]):
            a, b = ends[i], ends[i + 1]
            if a < b:
                out[a:b] = part[number[a:b] - self.places[i]]
        return out

    def bigram(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys."""
        out, n = np.zeros(len(keys), "int64"), self.spec["bigram_shards"]
        shard = _range(_spread(keys), n)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(n + 1))
        for k, stored in self.keys.items():
            mine = order[ends[k] : ends[k + 1]]
            if len(mine):
                at = np.minimum(np.searchsorted(stored, keys[mine]), len(stored) - 1)
                out[mine] = np.where(stored[at] == keys[mine], self.counts[k][at], 0)
        return out

    def score(self, flat: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Of texts as hashes() gives them: tokens, known tokens, base score, score."""
        s = self.spec
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        token = self.words.number(flat)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[starts] = s["start"]
        seen, back = np.unique(token, return_inverse=True)
        count, cont = self.of("count", seen), self.of("cont", seen)
        v = s["vocabulary"]
        base = np.log10((count + 1) / (s["tokens"] + v + 1))[back]
        uni = (np.maximum(cont - _discount(cont, s["e"]), 0) / max(s["distinct"], 1) + s["left"] / (v + 1))[back]
        firsts, fback = np.unique(before, return_inverse=True)
        total = self.of("context", firsts)
        d1, d2, d3 = s["d"]
        gamma = (d1 * self.of("n1", firsts) + d2 * self.of("n2", firsts) + d3 * self.of("n3", firsts)) / np.maximum(total, 1)
        gamma[total == 0] = 1.0
        keys, kback = np.unique((np.maximum(before, 0).astype("uint64") << np.uint64(32)) | np.maximum(token, 0).astype("uint64"), return_inverse=True)
        both = self.bigram(keys)[kback]
        both[(before < 0) | (token < 0)] = 0
        p = np.maximum(both - _discount(both, s["d"]), 0) / np.maximum(total, 1)[fback] + gamma[fback] * uni
        known = (count > 0)[back]
        return [lengths, np.add.reduceat(known.astype("int64"), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.asarray([0.0, *d])[np.minimum(c, 3)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many things were counted 1, 2, 3 and 4 times; each from 0 to its count."""
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y, out = n[0] / (n[0] + 2 * n[1]), []
    for i in range(3):
        out.append(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 1.0) if n[i] else i / 2 + 0.5)
    return tuple(out)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """hashes() of many texts at once, about GATHERED tokens."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            held.append(hashes(b.column("text").slice(at, ROWS)))
            n += len(held[-1][0])
            if n >= GATHERED:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def train(docs: DataFrame) -> dict:
    """Counts the texts, writes the model's files and returns what a Model needs to open them: places and totals, a few
    numbers for each shard."""
    spark = docs.sparkSession
    folder, parts = shared_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts, packed = docs.select("text"), "shard int, data binary"
    word_shards = parts

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, _ in _tokens(batches):
            keys, n = _summed(flat, np.ones(len(flat), "uint64"))
            yield _pack(keys, [n], _range(keys, word_shards), word_shards)

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (keys, n) in _by_shard(batches):
            _put(folder, f"words-{k}", keys)
            _put(folder, f"count-{k}", n)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (k, len(keys), int(n.sum()), int(n[keys == END].sum()))], names=["shard", "n", "tokens", "texts"])

    found = saved(_dealt(texts.mapInArrow(count_words, packed), parts).mapInArrow(store_words, "shard long, n long, tokens long, texts long"), "words")
    rows = sorted(found.collect())  # one row a shard
    words = [(r["shard"], r["n"]) for r in rows]
    tokens, vocabulary = sum(r["tokens"] for r in rows), sum(r["n"] for r in rows)
    if vocabulary >= 2**31:
        raise ValueError("more than 2**31 distinct words")
    start = vocabulary  # the number of START, after all words
    bigram_shards = max(4 * parts, math.ceil(tokens / SHARD))
    bigram_parts = max(parts, math.ceil(bigram_shards / 4))

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(folder, words, word_shards)
        for flat, lengths in _tokens(batches):
            token = known.number(flat).astype("uint64")
            before = np.empty_like(token)
            before[1:] = token[:-1]
            before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = start
            keys, n = _summed((before << np.uint64(32)) | token, np.ones(len(token), "uint64"))
            yield _pack(keys, [n], _range(_spread(keys), bigram_shards), bigram_shards)

    sizes = np.zeros(word_shards + 1, "int64")
    for k, n_words in words:
        sizes[k] = n_words
    sizes[word_shards] = 1
    # A shard's first number; an empty shard shares it with the next, which searchsorted from the right finds.
    first_numbers = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("uint64")

    def store_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            # One packed row for each shard of words and flush, not for each shard of bigrams.
            sums = _summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            out = _pack(sums[0], sums[1:], np.searchsorted(first_numbers, sums[0], "right") - 1, word_shards + 1)
            return pa.RecordBatch.from_arrays([*out.columns, *([pa.nulls(out.num_rows, pa.int64())] * 6)], names=_COUNTED)

        for k, (keys, n) in _by_shard(batches):
            _put(folder, f"bigrams-{k}", keys)
            _put(folder, f"bigram_counts-{k}", n)
            first, second, one = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), np.ones(len(keys), "uint64")
            zero = np.zeros(len(keys), "uint64")
            # By word: its count as a context, distinct bigrams counted 1, 2, 3+ times after it, distinct words before it.
            cols = [np.concatenate([x, y]) for x, y in ((n, zero), ((n == 1).astype("uint64"), zero), ((n == 2).astype("uint64"), zero), ((n > 2).astype("uint64"), zero), (zero, one))]
            held.append(_summed(np.concatenate([first, second]), *cols))
            if sum(len(x[0]) for x in held) > SHARD:
                yield flush()
            counts = [int((n == i).sum()) for i in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *(pa.array([x], pa.int64()) for x in (k, len(keys), *counts))], names=_COUNTED)
        if held:
            yield flush()

    counted = saved(_dealt(texts.mapInArrow(count_bigrams, packed), bigram_parts).mapInArrow(store_bigrams, "shard int, data binary, file long, n long, c1 long, c2 long, c3 long, c4 long"), "counted")
    files = sorted(counted.where("file is not null").select("file", "n", "c1", "c2", "c3", "c4").collect())  # one row a shard
    distinct = sum(r["n"] for r in files)

    def store_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (keys, *cols) in _by_shard(batches):
            at = (keys - first_numbers[k]).astype("int64")
            for name, col in zip(KINDS[1:], cols, strict=True):
                dense = np.zeros(sizes[k], "<u8")
                dense[at] = col
                _put(folder, f"{name}-{k}", dense)
            if k == word_shards:
                _put(folder, f"{KINDS[0]}-{k}", np.zeros(1, "<u8"))
            cont = cols[-1]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (k, *(int((cont == i).sum()) for i in (1, 2, 3, 4)), int((cont > 2).sum()))], names=["file", "c1", "c2", "c3", "c4", "more"])

    found = saved(_dealt(counted.where("file is null").select("shard", "data"), parts).mapInArrow(store_contexts, "file long, c1 long, c2 long, c3 long, c4 long, more long"), "contexts")
    by = found.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("c1", "c2", "c3", "c4", "more"))).first()
    d = discounts([sum(r[k] for r in files) for k in ("c1", "c2", "c3", "c4")])
    e = discounts([by[k] for k in ("c1", "c2", "c3", "c4")])
    left = (e[0] * by["c1"] + e[1] * by["c2"] + e[2] * by["more"]) / distinct if distinct else 1.0
    return {"folder": folder, "words": words, "word_shards": word_shards, "bigrams": [r["file"] for r in files], "bigram_shards": bigram_shards, "start": start, "tokens": tokens, "vocabulary": vocabulary, "distinct": distinct, "d": d, "e": e, "left": left}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every whole text; perplexity is 10 ** (-score / n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model["folder"] not in _models:
            _models.clear()
            _models[model["folder"]] = Model(model)
        own = _models[model["folder"]]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *map(pa.array, own.score(*hashes(some.column("text"))))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_held_out(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Learns from the documents of all folds but one and scores every document."""
    model = train(docs.where(~held_out(F.col("doc_id"), folds, fold)))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
