"""Which texts hold which of many passages, whole and as they are written, in one pass over the texts.

A passage is told by a hash of its first bytes: as many as the greatest power of two, up to ANCHOR, that it has. Each text
is hashed at all its places by doubling (a window's hash is its halves' put together) and looked up, first in a table of
bits, then among the sorted hashes of all passages. Where one is found, the digest of as many bytes as the passage has is
taken; if it is a passage's, a row (doc, digest) goes on to an equi-join with the passages. So a text becomes no rows but
its hits, and workers get 40 bytes a passage, not its text. Up to MOST passages are looked for in one pass.

Defined cases: null and empty passages are in no text; null texts hold none; repeated rows and passages of one text give
each pair once; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import pieces, saved
from .keywords import PIECE, text_buffers

ANCHOR, BITS, MOST = 32, 22, 2_000_000
_BASE = 0x9E3779B97F4A7C15


def window_hashes(x: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """For each of the sizes (powers of two) the hashes of all windows of so many bytes."""
    out, h, m = {}, x.astype("uint64") + np.uint64(1), 1
    while True:
        if m in sizes:
            out[m] = h
        if m >= max(sizes) or len(h) <= m:
            return out
        h = h[:-m] + h[m:] * np.uint64(pow(_BASE, m, 1 << 64))
        m *= 2


def _anchor(raw: bytes) -> tuple[int, int]:
    """(bytes, hash) of a passage's first window."""
    size = min(ANCHOR, 1 << (len(raw).bit_length() - 1))
    return size, int(window_hashes(np.frombuffer(raw[:size], "u1"), {size})[size][0])


class Finder:
    def __init__(self, keys: list[tuple[int, int, int, int]]):
        """keys: size and hash of the first window, bytes, first 8 bytes of the digest."""
        by: dict[int, dict[int, set[int]]] = {}
        for size, h, length, _ in keys:
            by.setdefault(size, {}).setdefault(h, set()).add(length)
        self.known = {k[3] for k in keys}
        self.tables = {}
        for size, own in by.items():
            hashes = np.array(sorted(own), "uint64")
            bits = np.zeros(1 << BITS, bool)
            bits[hashes >> np.uint64(64 - BITS)] = True
            self.tables[size] = (hashes, [sorted(own[int(h)]) for h in hashes], bits)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, bytes]]:
        """(row, digest) of the passages in rows of UTF-8."""
        out: set[tuple[int, bytes]] = set()
        raw, first, last = memoryview(data), int(offsets[0]), int(offsets[-1])
        for at in range(first, last, PIECE):
            stop = min(at + PIECE, last)
            for size, h in window_hashes(data[at : min(stop + ANCHOR - 1, last)], set(self.tables)).items():
                hashes, lengths, bits = self.tables[size]
                h = h[: stop - at]
                places = np.flatnonzero(bits[h >> np.uint64(64 - BITS)])
                which = np.minimum(np.searchsorted(hashes, h[places]), len(hashes) - 1)
                hit = hashes[which] == h[places]
                places, which = places[hit] + at, which[hit]
                rows = np.searchsorted(offsets, places, "right") - 1
                for p, k, r in zip(places.tolist(), which.tolist(), rows.tolist(), strict=True):
                    for n in lengths[k]:
                        if p + n <= offsets[r + 1]:
                            digest = hashlib.sha256(raw[p : p + n]).digest()
                            if int.from_bytes(digest[:8], "big", signed=True) in self.known:
                                out.add((r, digest))
        return out


def find_passages(docs: DataFrame, passages: DataFrame, doc: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(query, doc), distinct: of passages (query, passage) and documents, who holds whom."""
    own = passages.select("query", F.col("passage").cast("string").alias("passage")).where(F.length("passage") > 0)
    own = saved(own.withColumn("digest", F.unhex(F.sha2("passage", 256))), "passages")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [(*_anchor(raw), len(raw), int.from_bytes(hashlib.sha256(raw).digest()[:8], "big", signed=True)) for t in b.column("passage") for raw in [t.as_py().encode()]]
            size, h, length, digest = zip(*keys, strict=True) if keys else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(np.array(h, "uint64").astype("int64")), pa.array(length, pa.int64()), pa.array(digest, pa.int64())], names=["size", "h", "length", "digest"])

    keys = saved(own.select("passage").distinct().mapInArrow(anchors, "size int, h long, length long, digest long").distinct(), "anchors")
    passes = max(1, -(-keys.count() // most))
    texts = docs.select(F.col(doc).alias("doc"), F.coalesce(text, F.lit("")).alias("t"))
    found = None
    for k in range(passes):
        part = [(r["size"], r["h"] % (1 << 64), r["length"], r["digest"]) for r in keys.where(F.pmod("h", F.lit(passes)) == k).collect()]  # about `most` rows
        hits = _looked_up(texts, part)
        found = hits if found is None else found.unionByName(hits)
    return found.join(own.select("query", "digest"), "digest").select("query", "doc").distinct()


def _looked_up(texts: DataFrame, keys: list[tuple[int, int, int, int]]) -> DataFrame:
    finder: list[Finder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder[:] = finder or [Finder(keys)]
        for b in pieces(batches):
            hits = sorted(finder[0].find(*text_buffers(b.column("t")))) if keys and b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array([r for r, _ in hits], pa.int64())), pa.array([d for _, d in hits], pa.binary())], names=["doc", "digest"])

    return texts.mapInArrow(run, f"doc {texts.schema['doc'].dataType.simpleString()}, digest binary")
