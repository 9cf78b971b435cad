"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids, stripe-parallel reads.

Files are written in ascending document order: the documents are range-partitioned by id and sorted, one file a
partition, each row holding its place inside the file's token stream. A manifest of one row a file gives each file's
first token, so a reader needs no shuffle: any stripe can be read alone, and a query for one id skips files and
stripes by their statistics and Bloom filters.

Defined cases: a null text is the empty text and holds the end id alone; null ids come first; rows of one id are
ordered by their text; an empty table writes no token; only columns doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, shared_dir, tidy

#: Appended to every document.
END = 0
#: Pieces that a worker remembers, places of its table (a power of two), and how many of them a piece may try.
MEMORY, SLOTS, PROBES = 1_250_000, 1 << 21, 16
#: Pieces looked up at a time.
AT_ONCE = 200_000

_models: dict[str, Memory] = {}

ROW = "doc_id long, file int, local_start long, n_tokens long, ids array<int>"


#: Classes of bytes: ASCII letters, white space (the tokenizer's and four controls), other ASCII but for blank and apostrophe.
_BYTE = np.arange(256)
_LETTER = np.isin(_BYTE, [*range(65, 91), *range(97, 123)])
_SPACE = np.isin(_BYTE, [*range(9, 14), *range(28, 33)])
_OTHER = (_BYTE < 128) & ~_LETTER & ~np.isin(_BYTE, [32, 39])
#: First bytes of two-byte characters that are letters: U+00C0 to U+01FF (but for two signs) and U+0400 to U+047F.
_LEAD = np.isin(_BYTE, [*range(0xC3, 0xC8), 0xD0, 0xD1])
#: Keeps the first n bytes of eight.
_FIRST = np.asarray([(1 << 8 * n) - 1 for n in range(9)], "<u8")


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to letters, and which are the last of a white-space character. Letters of scripts that are not
    listed count as neither letters nor others."""
    letter, space = _LETTER[x], _SPACE[x]
    if len(x) and x.max() > 127:
        pad = np.concatenate([np.zeros(2, "u1"), x])
        a, b = pad[:-2], pad[1:-1]  # the two bytes before each
        sign = (b == 0xC3) & ((x == 0x97) | (x == 0xB7))
        letter |= (_LEAD[b] & ~sign) | _LEAD[x]
        letter[:-1] &= ~sign[1:]
        space |= (b == 0xC2) & ((x == 0x85) | (x == 0xA0))
        space |= (a == 0xE2) & (((b == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))) | ((b == 0x81) & (x == 0x9F)))
        space |= ((a == 0xE1) & (((b == 0x9A) & (x == 0x80)) | ((b == 0xA0) & (x == 0x8E)))) | ((a == 0xE3) & (b == 0x80) & (x == 0x80))
    return letter, space


def _cut(x: np.ndarray, letter: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Bytes at which a byte-level pre-token begins whatever stands around: a blank after something else than white space;
    the change between letters and others, apostrophes apart, unless two white-space characters stand before."""
    first, other = np.zeros(len(x), bool), _OTHER[x]
    first[1:] = (letter[:-1] & other[1:]) | (other[:-1] & letter[1:])
    first[2:] &= ~(space[:-2] & space[1:-1])
    first[1:] |= (x[1:] == 32) & ~space[:-1]
    return first


class Memory:
    """Pieces of texts with their ids. A piece of up to 16 bytes is found by these as two numbers, all pieces of a batch at
    once in a table of places; others are found by a dictionary. Place 0 is the end of a document."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.model = model.encode_batch_fast
        (self.line,) = self.model(["\n"], add_special_tokens=False)[0].ids
        #: Tokens that the library looks for in whole texts, before it cuts them.
        self.special = [x.content.encode() for x in model.get_added_tokens_decoder().values()]
        self._start(np.zeros((1, 2), "<u8"), np.asarray([0, 1]), np.asarray([END], "int32"), {})

    def _start(self, keys: np.ndarray, at: np.ndarray, ids: np.ndarray, long: dict[bytes, int]) -> None:
        """at: a place's ids are ids[at[place] : at[place + 1]]. Pieces in long have keys 0, 0."""
        self.n, self.keys, self.at, self.ids, self.long = len(keys), keys, at, ids, long
        self.again = np.zeros(len(keys), bool)
        self.slots = np.zeros(SLOTS, "int32")
        if len(unplaced := self._place(np.flatnonzero(keys[:, 0]))):
            long.update((k.tobytes().rstrip(b"\0"), int(p)) for k, p in zip(keys[unplaced], unplaced, strict=True))
            keys[unplaced] = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1])) & np.uint64(SLOTS - 1)).astype("int64")

    def _place(self, places: np.ndarray) -> np.ndarray:
        """Puts places into the table by their keys and returns those for which PROBES slots were taken."""
        slot = self._slot(self.keys[places])
        for _ in range(PROBES):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = places[free]
            left = self.slots[slot] != places
            places, slot = places[left], (slot[left] + 1) & (SLOTS - 1)
        return places

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places by keys, 0 for those that the table lacks."""
        slot = self._slot(keys)
        out = self.slots[slot]
        wrong = np.flatnonzero((self.keys[out] != keys).any(axis=1))
        here = out[wrong]
        out[wrong] = 0
        for _ in range(PROBES - 1):
            wrong = wrong[here != 0]
            if not len(wrong):
                break
            slot[wrong] = (slot[wrong] + 1) & (SLOTS - 1)
            here = self.slots[slot[wrong]]
            right = (self.keys[here] == keys[wrong]).all(axis=1) & (here != 0)
            out[wrong[right]] = here[right]
            wrong, here = wrong[~right], here[~right]
        return out

    def _learn(self, pieces: list[bytes], alone: np.ndarray, keys: np.ndarray) -> None:
        """Appends pieces in the given order. Those that stay apart from a line feed on either side are encoded as the lines of
        one text, those alone one by one; they come last. Keys are 0, 0 for those that go into the dictionary."""
        lines, rest = pieces[: len(pieces) - int(alone.sum())], pieces[len(pieces) - int(alone.sum()) :]
        counts, ids = [], []
        if lines:
            (whole,) = self.model(["\n" + b"\n".join(lines).decode() + "\n"], add_special_tokens=False)
            found = np.asarray(whole.ids, "int32")
            parts = np.flatnonzero(found == self.line)
            assert len(parts) == len(lines) + 1
            counts, ids = [np.diff(parts) - 1], [found[found != self.line]]
        if rest:
            each = [np.asarray(e.ids, "int32") for e in self.model([p.decode() for p in rest], add_special_tokens=False)]
            counts.append(np.asarray([len(e) for e in each]))
            ids += each
        n, end = self.n, int(self.at[self.n])
        new = np.concatenate([[end], end + np.cumsum(np.concatenate(counts))])
        self.n = n + len(pieces)
        self.keys, self.at, self.ids, self.again = (_room(a, k) for a, k in ((self.keys, self.n), (self.at, self.n + 1), (self.ids, int(new[-1])), (self.again, self.n)))
        self.keys[n : self.n], self.at[n : self.n + 1], self.ids[end : new[-1]], self.again[n : self.n] = keys, new, np.concatenate(ids), False
        unplaced = self._place(n + np.flatnonzero(keys[:, 0]))
        self.keys[unplaced] = 0
        self.long.update((pieces[p - n], int(p)) for p in (*(n + np.flatnonzero(keys[:, 0] == 0)), *unplaced))

    def _age(self) -> None:
        """When full, forgets the pieces that were not met again, or all if few were not."""
        if self.n > MEMORY or self.at[self.n] > 16 * MEMORY:
            keep = self.again[: self.n].copy()
            n = np.diff(self.at[: self.n + 1])
            if 4 * keep.sum() > 3 * MEMORY or n[keep].sum() > 12 * MEMORY:
                keep[:] = False
            keep[0] = True
            place = np.cumsum(keep) - 1
            self._start(self.keys[: self.n][keep], np.concatenate([[0], np.cumsum(n[keep])]), self.ids[: self.at[self.n]][np.repeat(keep, n)], {k: int(place[p]) for k, p in self.long.items() if keep[p]})

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, END after each, and each text's number of ids. Null is empty."""
        self._age()
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, "<i8")
        raw = (memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]].tobytes() if texts.buffers()[2] else b"") + bytes(16)
        offsets = offsets - offsets[0]
        x = np.frombuffer(raw, "u1", len(raw) - 16)
        letter, space = _classes(x)
        first = _cut(x, letter, space)
        whole = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for s in (b"\0", *self.special) for m in re.finditer(re.escape(s), raw[:-16])}
        for k in whole:  # texts with such a token or a NUL are encoded as they are
            first[offsets[k] : offsets[k + 1]] = False
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(x))[: len(starts)]
        before = np.searchsorted(starts, offsets)
        short = ends - starts <= 16
        for k in whole:
            short[before[k] : before[k + 1]] = False
        parts = [slice(i, i + AT_ONCE) for i in range(0, len(starts), AT_ONCE)]
        places = np.concatenate([np.zeros(0, "int32"), *(self._places(raw, space, starts[i], ends[i], short[i]) for i in parts)])
        places = np.insert(places, before[1:], 0)
        total = np.cumsum(self.at[places + 1] - self.at[places])
        ids = np.concatenate([np.zeros(0, "int32"), *(self._ids(places[i : i + AT_ONCE]) for i in range(0, len(places), AT_ONCE))])
        return ids, np.diff(total[before[1:] + np.arange(len(texts))], prepend=0)

    def _ids(self, places: np.ndarray) -> np.ndarray:
        at = self.at[places]
        n = self.at[places + 1] - at
        return self.ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _places(self, raw: bytes, space: np.ndarray, starts: np.ndarray, ends: np.ndarray, short: np.ndarray) -> np.ndarray:
        """The places of consecutive pieces of raw, after learning those that are missing. Short ones have keys."""
        words, size = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)), ends - starts
        keys = np.stack([words[starts] & _FIRST[np.minimum(size, 8)], words[starts + 8] & _FIRST[np.clip(size - 8, 0, 8)]], axis=1)
        keys[~short] = 0
        places = self._find(keys)
        self.again[places] = True
        missing = np.flatnonzero(places == 0)
        if len(missing):
            spaces = np.add.reduceat(space[: ends[-1]], starts, dtype="int64")[missing]
            blank = np.frombuffer(raw, "u1")[starts[missing]] == 32
            # White space other than one blank before something else does not stay apart from line feeds.
            alone = (spaces != blank) | blank & (size[missing] < 2) | ~short[missing]
            missing = missing[np.argsort(alone, kind="stable")]
            alone.sort()
            pieces = [raw[i:j] for i, j in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            new: dict[bytes, int] = {}
            places[missing] = at = np.asarray([self.long[p] if p in self.long else self.n + new.setdefault(p, len(new)) for p in pieces])
            self.again[at[at < self.n]] = True
            if new:
                unknown = np.flatnonzero(at >= self.n)
                first = unknown[np.unique(at[unknown], return_index=True)[1]]
                self._learn(list(new), alone[first], keys[missing[first]])
        return places


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or more room after its rows if it has fewer than n."""
    return a if n <= len(a) else np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])


def memory(path: str) -> Memory:
    """The worker's memory of a tokenizer file."""
    if path not in _models:
        _models[path] = Memory(path)
    return _models[path]


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian 32-bit integers. Texts are cut where no pre-token crosses and the pieces encoded
    one by one, each distinct piece once as long as the worker remembers it."""
    ids, n = memory(path).encode(pa.array(texts, pa.string()))
    data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(n)
    return [data[i : j - 4] for i, j in zip([0, *ends[:-1]], ends, strict=False)]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, known = TaskContext.get().partitionId(), 0, memory(path)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                some = b.slice(at, 100)
                flat, n = known.encode(some.column("text"))
                offsets = np.concatenate([[0], np.cumsum(n)]).astype("int32")
                starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), part, "int32")), pa.array(starts.astype("int64")), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "file", "local_start", "n_tokens", "ids"],
                )

    return run


def write(docs: DataFrame, path: str, tokenizer: str, files: int | None = None, stripe_bytes: int = 64 << 20, stride: int = 10_000) -> str:
    """Writes `path`/data (ORC, one file a range of ids) and `path`/manifest (file, first, n_docs, n_tokens)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Ranges of ids alone: the sample that Spark draws for their bounds holds no texts.
    rows = (rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")).sortWithinPartitions("doc_id", "text")
    writer = rows.mapInArrow(tidy(_encode(tokenizer)), ROW).write.option("compression", "zstd")
    for k, v in {"orc.create.index": True, "orc.row.index.stride": stride, "orc.stripe.size": stripe_bytes, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}.items():
        writer = writer.option(k, v)
    writer.orc(f"{path}/data")
    ends = spark.read.schema(ROW).orc(f"{path}/data").groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    before = W.partitionBy(F.lit(1)).orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    ends.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"), "n_docs", "n_tokens").write.orc(f"{path}/manifest")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. Filters on doc_id reach the ORC reader."""
    manifest = spark.read.schema("file int, first long, n_docs long, n_tokens long").orc(f"{path}/manifest").select("file", "first")
    data = spark.read.schema(ROW).orc(f"{path}/data")
    return data.join(manifest, "file").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crcs = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype("int64")), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), all from the files;
    n_tokens is the length of the ids that were read."""
    return read(spark, path).mapInArrow(tidy(_crc32), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    return digests(spark, write(docs, f"{shared_dir(spark)}/tokens", tokenizer))
