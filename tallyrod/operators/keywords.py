"""Occurrences of any number of keywords in texts, in one pass over each text.

A keyword is told by its first eight bytes, or all of them if it has fewer. At every place of a text these bytes are one
number per length, which is looked up in a table of bits and, where that is set, among the sorted numbers of all keywords;
only what is found there is compared in full. So the time does not depend on how many keywords there are, and texts are
read in pieces of bounded size, however long they are. The keywords go to every task: about 100 bytes each.

Keywords with a blank or more than five letters count as parts of a text, others as beginnings of words: at the start of
the text or after a character that is no letter, digit or underscore. Occurrences of one keyword do not overlap; a
beginning's own character in front belongs to it. The empty keyword never occurs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import pieces

#: Bytes of text that are looked at at once; bits of the table of each length.
PIECE, BITS = 1 << 20, 20
ANCHOR = 8

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def begins_words(keyword: str) -> bool:
    return " " not in keyword and len(keyword) <= 5


class Scanner:
    def __init__(self, keywords: Sequence[str]):
        self.words = [k.encode() for k in keywords]
        self.begins = [begins_words(k) for k in keywords]
        by: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            if w:
                a = w[:ANCHOR]
                by.setdefault(len(a), {}).setdefault(int.from_bytes(a, "little"), []).append(i)
        # Of each length: sorted numbers, the keywords of each, whether all of them begin words, the table of bits.
        self.groups = []
        for size, own in sorted(by.items()):
            numbers = np.array(sorted(own), "uint64")
            lists = [own[int(x)] for x in numbers]
            bits = np.zeros(1 << BITS, bool)
            bits[self._slot(numbers)] = True
            self.groups.append((size, numbers, lists, np.array([all(self.begins[i] for i in x) for x in lists]), bits))

    @staticmethod
    def _slot(numbers: np.ndarray) -> np.ndarray:
        return (numbers * _MIX) >> np.uint64(64 - BITS)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], int]:
        """(row, keyword) -> occurrences, for rows data[offsets[r]:offsets[r + 1]] of lowered UTF-8."""
        raw = memoryview(data)
        found: dict[tuple[int, int], list[int]] = {}  # occurrences, and where the last one ends
        first, last = int(offsets[0]), int(offsets[-1])
        for at in range(first, last, PIECE):
            stop = min(at + PIECE, last)
            x = data[at : min(stop + ANCHOR - 1, last)]
            number, have = np.zeros(len(x), "uint64"), 0
            for size, numbers, lists, only, bits in self.groups:
                while have < size:
                    number = number[: len(x) - have] | (x[have:].astype("uint64") << np.uint64(8 * have))
                    have += 1
                near = number[: stop - at]
                places = np.flatnonzero(bits[self._slot(near)])
                which = np.searchsorted(numbers, near[places])
                hit = numbers[np.minimum(which, len(numbers) - 1)] == near[places]
                places, which = places[hit] + at, which[hit]
                rows = np.searchsorted(offsets, places, "right") - 1
                begin = offsets[rows]
                fits = (places + size <= offsets[rows + 1]) & ~(only[which] & (places > begin) & _IN_WORD[data[np.maximum(places - 1, 0)]])
                for p, k, r, b in zip(places[fits].tolist(), which[fits].tolist(), rows[fits].tolist(), begin[fits].tolist(), strict=True):
                    for i in lists[k]:
                        w = self.words[i]
                        if len(w) > ANCHOR and (p + len(w) > offsets[r + 1] or raw[p : p + len(w)] != w):
                            continue
                        start = p
                        if self.begins[i] and p > b:
                            start = self._before(raw, p)
                            if start < 0:
                                continue
                        own = found.setdefault((r, i), [0, b])
                        if start >= own[1]:
                            own[0] += 1
                            own[1] = p + len(w)
        return {k: n for k, (n, _) in found.items()}

    @staticmethod
    def _before(raw: memoryview, p: int) -> int:
        """Where the character before p starts, if a word can begin after it; else -1."""
        a = p - 1
        if raw[a] < 128:
            return -1 if _IN_WORD[raw[a]] else a
        while raw[a] & 0xC0 == 0x80:
            a -= 1
        return -1 if unicodedata.category(bytes(raw[a:p]).decode("utf-8", "replace"))[0] in "LN" else a


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], "int64", n + 1, texts.offset * 8) if n else np.zeros(1, "int64")
    data = np.frombuffer(texts.buffers()[2], "u1") if n and texts.buffers()[2] is not None else np.empty(0, "u1")
    return data, offsets


def _word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each row, at least one."""
    out, first, last = np.zeros(len(offsets) - 1, "int64"), int(offsets[0]), int(offsets[-1])
    for at in range(first, last, PIECE):
        x = data[max(at - 1, first) : min(at + PIECE, last)]
        begin = ~_SPACE[x]
        begin[1:] &= _SPACE[x[:-1]]
        places = np.flatnonzero(begin) + max(at - 1, first)
        places = places[places >= at]
        out += np.bincount(np.searchsorted(offsets, places, "right") - 1, minlength=len(out))
    # Words that go on from the row before are those rows' firsts, too.
    starts, ends = offsets[:-1], offsets[1:]
    goes_on = (starts < ends) & (starts > first)
    rows = np.flatnonzero(goes_on)
    rows = rows[~_SPACE[data[starts[rows]]] & ~_SPACE[data[starts[rows] - 1]]]
    out[rows] += 1
    return np.maximum(out, 1)


def counted(docs: DataFrame, keywords: Sequence[str], doc: str = "doc_id", text: str = "text", **more: Callable[[Column], Column]) -> DataFrame:
    """(doc, words, hits, more...), one row a document: its number of words and its keywords with their occurrences,
    array<struct<keyword, n>>. more: further columns, made from the lowered text in the same pass. A null text is empty."""
    keywords = list(dict.fromkeys(keywords))
    low = docs.select(F.col(doc).alias("doc"), F.lower(F.coalesce(text, F.lit(""))).alias("__t"))
    low = low.select("doc", *(make(F.col("__t")).alias(k) for k, make in more.items()), "__t")
    names = ["doc", *more]
    scanner: list[Scanner] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner[:] = scanner or [Scanner(keywords)]
        known = pa.array(keywords, pa.string())
        kinds = pa.struct([("keyword", pa.string()), ("n", pa.int32())])
        for b in pieces(batches):
            data, offsets = text_buffers(b.column("__t"))
            hits = scanner[0].count(data, offsets)
            keys = np.array(sorted(hits), "int64").reshape(-1, 2)
            ends = np.searchsorted(keys[:, 0], np.arange(b.num_rows + 1)).astype("int32")
            n = pa.array([hits[r, k] for r, k in keys.tolist()], pa.int32())
            values = pa.StructArray.from_arrays([known.take(pa.array(keys[:, 1])), n], fields=list(kinds))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(_word_counts(data, offsets).astype("int32")), pa.ListArray.from_arrays(pa.array(ends), values)], names=[*names, "words", "hits"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in low.schema.fields[: len(names)])
    return low.mapInArrow(run, f"{kept}, words int, hits array<struct<keyword:string,n:int>>")
