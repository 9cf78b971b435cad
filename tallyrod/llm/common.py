"""What several of the operators share: word classes, shared scratch tables, input tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved, shared_dir

__all__ = ["LOWER", "UPPER", "fold", "hashed_words", "mix", "partitions", "saved", "shared_dir", "table", "tidy", "words", "words_of"]

#: Characters that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else, so that the result does not depend on a Unicode version."""
    return (text or "").encode("utf-8", "replace").lower()


def words_of(text: str | None) -> list[bytes]:
    """The folded words: bytes.split() parts at the characters of SPACE and no others."""
    return fold(text).split()


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes of text that are hashed at once.
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
#: A 64-bit value for each byte: 0 for those that part words, one for both cases of A-Z.
_VALUE = mix(np.arange(1, 257, dtype="uint64") * np.uint64(_BASE))
_VALUE[_IS_SPACE] = 0
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, "uint64"), np.full(n, pow(_BASE, -1, 2**64), "uint64")
    up[0] = down[0] = 1
    return np.cumprod(up, dtype="uint64"), np.cumprod(down, dtype="uint64")


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the folded words of all texts, one text after the other, and each text's number of words. Null
    is empty. A word's hash is the sum of its bytes' values times powers of an odd base, finalized; whole buffers are
    hashed at once, piece by piece, so memory stays bounded for texts of any length."""
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = "int64" if pa.types.is_large_string(texts.type) else "int32"
    offsets = np.frombuffer(texts.buffers()[1], wide, n + 1, texts.offset * np.dtype(wide).itemsize).astype("int64") if n else np.zeros(1, "int64")
    data = np.frombuffer(texts.buffers()[2], "u1") if n and texts.buffers()[2] is not None else np.empty(0, "u1")
    out, counts, at, end = [], np.zeros(n, "int64"), int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + _PIECE, end)
        if stop < end:  # ends at a text's start or after a blank
            row = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            length = _PIECE
            while row <= at and stop < end:
                blanks = np.flatnonzero(_IS_SPACE[data[at:stop]])
                if len(blanks):
                    row = at + int(blanks[-1]) + 1
                    break
                length *= 2
                stop = min(at + length, end)
                row = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            stop = row if row > at else stop
        x = data[at:stop]
        space = _IS_SPACE[x]
        first = ~space
        first[1:] &= space[:-1]
        a, b = np.searchsorted(offsets, [at, stop])
        starts = offsets[a:b] - at
        first[starts] = ~space[starts]
        begin = np.flatnonzero(first)
        size = 1 << max(20, (stop - at - 1).bit_length())
        up, down = _powers(size)
        if len(begin):
            sums = np.add.reduceat(_VALUE[x] * up[: len(x)], begin)
            out.append(mix(sums * down[begin]))
            np.add.at(counts, np.searchsorted(offsets, begin + at, "right") - 1, 1)
        at = stop
    return np.concatenate(out) if out else np.empty(0, "uint64"), counts


def words(text: Column) -> Column:
    """The words of a text column; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, before and after which freed memory goes back to the system: workers are used again by later stages, and would
    else keep the most that any of them took."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        try:
            yield from run(batches)
        finally:
            _release()

    return whole


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
