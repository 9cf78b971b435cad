"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik 2006), down to classes of linked documents.

Sets of word shingles are compared as sets of 64-bit hashes. Documents of one set form a class. Sizes are cut into
bands whose ends differ by the threshold, so linked sets lie in one band or in two that touch, and share a band
instance; there their symmetric difference is at most k. The domain of shingles is cut into n1 partitions, each of
these into n2 parts. In one of the partitions at least, linked sets differ in at most k2 parts. Each subset of
n2 - k2 parts of a partition makes a signature of their content, so linked sets share one. Subsets without content make
none, except in sets that have such subsets in more partitions than are spare; that keeps it exact.

Sets that share a signature are first compared with one leader only: each class meets the leader with which it shares
most signatures, so a group of any size costs one pair a class. Groups whose members are all connected then need no
more. In the others, bitmaps, which can only rule out, are compared inside the group: first each class meets the one
class that may be most similar to it, again one pair a class; then members that are still not connected meet all that
bitmaps don't rule out. Every pair is checked exactly. Groups of more than MOST classes are compared in slices at
first, and then their classes meet in a prefix filter join (rarest shingles first) in place of all bitmaps.

Defined cases: null, empty or blank texts have no shingles and are linked with nothing, not even each other; texts of
fewer words than n are one shingle; exact copies and repeated rows are one class; null ids take part but name no
class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, saved, tidy
from .components import components

#: Signatures that a task gathers before it sorts and emits them.
GATHERED = 600_000
#: Signatures in one shard of the grouping.
SHARD = 1_500_000
#: Ids or tokens that may be broadcast; beyond that Spark joins by shuffle, or a token must be more frequent to count as hot.
BROADCAST_ROWS = 1_000_000

#: Classes of a group that are compared inside it; larger groups go through the prefix filter.
MOST = 4_096
#: Bits of a bitmap; those of longer sets are fuller and rule out less.
MOST_BITS = 8_192
#: Up to so many errors a band has one partition, of k + 2 parts; else its partitions have three parts, one of which may differ.
FEW = 8
#: A share of sets that may have more partitions with empty subsets than are spare.
RARE = 0.002

_M = np.uint64(0x9E3779B97F4A7C15)
_TOP48 = np.uint64(0xFFFFFFFFFFFF0000)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles."""

    def windows(h: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(max(0, len(h) - width + 1), "uint64")
        for i in range(width):
            out = out * _M + h[i : i + len(out)]
        return mix(out + np.uint64(width))

    for at in range(0, len(texts), 500):
        h, counts = hashed_words(texts.slice(at, 500))
        full, start = windows(h, n), 0
        for count in counts.tolist():
            if count >= n:
                yield np.unique(full[start : start + count - n + 1])
            else:
                yield windows(h[start : start + count], count) if count else np.empty(0, "uint64")
            start += count


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Bands:
    """Bands of sizes, and the instance of each; the threshold is num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low, self.high, self.instances = num, den, [1], [], []
        self._grow(64)

    def _grow(self, size: int) -> None:
        while len(self.high) < 2 or self.high[-2] <= size:
            low = self.high[-1] + 1 if self.high else 1
            high = low * self.den // self.num
            least = self.low[-1] if self.high else 1  # of the band below, which uses this instance too
            if self.high:
                self.low.append(low)
            self.high.append(high)
            self.instances.append(Instance(len(self.instances), 2 * high * (self.den - self.num) // (self.den + self.num), least))

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of sets that aren't empty: signatures, those of each set's band and of the next, and the place of their set."""
        sizes = np.asarray([len(s) for s in sets], "int64")
        self._grow(int(sizes.max()))
        band, sigs, owners = np.searchsorted(self.high, sizes), [], []
        for k in np.unique(band).tolist():
            own = np.flatnonzero(band == k)
            flat = np.concatenate([sets[i] for i in own.tolist()])
            for instance in self.instances[k : k + 2]:
                if instance.k:
                    sig, at = instance.signatures(flat, sizes[own])
                    sigs.append(sig)
                    owners.append(own[at])
        return np.concatenate([np.empty(0, "uint64"), *sigs]), np.concatenate([np.empty(0, "int64"), *owners])


class Instance:
    """PartEnum for sets of `least` elements or more whose symmetric difference is at most k. Sets with k = 0 are equal
    and so of one class; they need no signature."""

    def __init__(self, number: int, k: int, least: int):
        self.k, self.spare = k, 0
        if not k:
            return
        if k <= FEW:
            n1, n2 = 1, k + 2
        else:
            # Of k // 2 partitions each may differ in two parts. Of those that are spare, some may have two empty parts.
            n2, best = 3, 1.0
            for spare in range(k):
                empty = math.exp(-least / (n2 * (k // 2 + 1 + spare)))
                mean = (k // 2 + 1 + spare) * (3 * empty**2 * (1 - empty) + empty**3)
                more = 1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(spare + 1))
                if more < best:
                    best, self.spare = more, spare
                if more < RARE:
                    break
            n1 = k // 2 + 1 + self.spare
        self.n1, self.n2 = n1, n2
        self.one, self.two = np.triu_indices(n2, 1)  # subsets of n2 - k2 = 2 parts
        self.names = mix(np.arange(n1 * len(self.one), dtype="uint64") + np.uint64(number << 32)).reshape(n1, -1)

    def signatures(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sets of these sizes, one after the other: signatures and the place of their set."""
        parts, m = self.n1 * self.n2, len(sizes)
        key = np.repeat(np.arange(m), sizes) * parts + (((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype("int64")
        at = np.flatnonzero(np.diff(key, prepend=-1))  # keys rise: sets are sorted, and parts are ranges
        content, empty = np.zeros(m * parts, "uint64"), np.ones(m * parts, bool)
        content[key[at]], empty[key[at]] = np.add.reduceat(mix(flat), at), False
        content, empty = content.reshape(m, self.n1, self.n2), empty.reshape(m, self.n1, self.n2)
        # 48 bits are enough: sets that share one by chance are only compared in vain.
        sigs = mix(content[:, :, self.one] * _M + mix(content)[:, :, self.two] + self.names) & _TOP48
        none = empty[:, :, self.one] & empty[:, :, self.two]
        keep = ~none | (none.any(2).sum(1) > self.spare)[:, None, None]
        return sigs[keep], np.repeat(np.arange(m), keep.sum((1, 2)))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, n_shingles, cls) of every row; key: a hash of the text; cls is null where there are no shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, cls = [], []
            for s in shingle_sets(b.column("text"), n):
                sizes.append(len(s))
                cls.append(class_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(sizes, pa.int64()), pa.array(cls, pa.int64())], names=["doc_id", "key", "n_shingles", "cls"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text").mapInArrow(run, "doc_id long, key long, n_shingles long, cls long")


def text_key() -> Column:
    return F.xxhash64("text")


def _same_row(doc_id: Column) -> Column:
    """Rows of one id and text; a null id is like another."""
    return doc_id.cast("long").eqNullSafe(F.col("__id")) & (text_key() == F.col("__key"))


def _packed(sig: np.ndarray, cls: np.ndarray) -> bytes:
    """Sorted signatures as steps, by byte planes, whose zeros compress; classes as they are."""
    planes = np.ascontiguousarray(np.diff(sig, prepend=np.uint64(0)).view("u1").reshape(-1, 8).T).tobytes()
    return len(sig).to_bytes(4, "little") + cls.tobytes() + bytes(pa.compress(planes, codec="zstd"))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4 + 8 * n :], decompressed_size=8 * n, codec="zstd"), "u1").reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("uint64").reshape(n), dtype="uint64"), np.frombuffer(data, "int64", n, 4)


_STAR = "sig long, member long, leader long"


def _led(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """Of rows (signature, class): each signature with its least class, and the others as members led by it."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    leader = cls[new][np.cumsum(new) - 1]
    rest = cls != leader
    rest[1:] &= (cls[1:] != cls[:-1]) | new[1:]
    return sig[new], cls[new], pa.RecordBatch.from_arrays([pa.array(sig[rest].view("int64")), pa.array(cls[rest]), pa.array(leader[rest])], names=["sig", "member", "leader"])


def stars(docs: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """Rows (sig, member, leader) of the signatures that several classes share; through them all are connected."""
    shards = 4 * parts  # several a partition, so that hashing deals them out evenly

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, sigs, cls, held = Bands(num, den), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, lead, rest = _led(np.concatenate(sigs), np.concatenate(cls))
            empty = pa.nulls(rest.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.nulls(rest.num_rows, pa.int32()), empty], names=["sig", "member", "leader", "shard", "data"])
            shard = ((sig >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # rises with the signature
            ends = np.searchsorted(shard, np.arange(shards + 1, dtype="uint64"))
            some = [k for k in range(shards) if ends[k] < ends[k + 1]]
            data = [_packed(sig[ends[k] : ends[k + 1]], lead[ends[k] : ends[k + 1]]) for k in some]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["sig", "member", "leader", "shard", "data"])
            sigs.clear()
            cls.clear()

        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = [s for s in shingle_sets(b.column("text").slice(at, 500), n) if len(s)]
                if sets:
                    sig, owner = bands.signatures(sets)
                    sigs.append(sig)
                    cls.append(np.asarray([class_of(s) for s in sets], "int64")[owner])
                    held += len(sig)
                if held > GATHERED:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by shard: one shard's parts are held at a time.
        now, sigs, cls = None, [], []
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("data"), strict=True):
                if shard != now and sigs:
                    yield _led(np.concatenate(sigs), np.concatenate(cls))[2]
                    sigs, cls = [], []
                now = shard
                sig, lead = _unpacked(data.as_py())
                sigs.append(sig)
                cls.append(lead)
        if sigs:
            yield _led(np.concatenate(sigs), np.concatenate(cls))[2]

    found = docs.select("text").mapInArrow(gather, _STAR + ", shard int, data binary")
    # Both kinds of row go through one shuffle (the members by their own hash), so the texts are read once.
    to = F.coalesce("shard", F.pmod(F.xxhash64("sig", "member"), F.lit(shards)).cast("int"))
    dealt = found.withColumn("to", to).repartition(parts, "to").sortWithinPartitions("shard")

    @tidy
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs() -> Iterator[pa.RecordBatch]:
            for b in batches:
                is_blob = b.column("shard").is_valid()
                rest = b.filter(pc.invert(is_blob)).select(["sig", "member", "leader"])
                if rest.num_rows:
                    out.append(rest)
                yield b.filter(is_blob)
        out: list[pa.RecordBatch] = []
        for x in meet(blobs()):
            yield from out
            out.clear()
            yield x
        yield from out

    return dealt.mapInArrow(both, _STAR)


def sketch(s: np.ndarray) -> np.ndarray:
    """A bitmap of at least four bits an element, but of MOST_BITS at most, at the elements' low bits; its length is a power
    of two."""
    bits = min(MOST_BITS, max(64, 1 << (4 * len(s) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype("int64")] = True
    return np.packbits(out, bitorder="little")


def possible(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, num: int, den: int) -> bool:
    """False only if the sets of these sketches and sizes surely are not linked: a bit that only one of them has is an
    element that only it has."""
    if len(a) > len(b):
        a, n_a, b, n_b = b, n_b, a, n_a
    if len(a) < len(b):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)), 0)
    both = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return den * both >= num * (n_a + n_b - both)


def _texts_of(docs: DataFrame, needed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of the documents that stand for the classes in `needed` (cls, doc_id, key), and `needed`, written."""
    needed = saved(needed, "needed")
    ids = needed.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    if needed.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "text").join(ids, _same_row(F.col("doc_id")), "left_semi").select("text"), needed


def sketches_of(docs: DataFrame, n: int, needed: DataFrame) -> DataFrame:
    """(cls, size, data) of the classes in `needed`; data: the sketch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column("text"), n))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["cls", "size", "data"])

    # Written with one row a class, so that joins have plain inputs, of which Spark can split a class with many partners.
    own, _ = _texts_of(docs, needed)
    return saved(own.mapInArrow(run, "cls long, size long, data binary").dropDuplicates(["cls"]), "sketches")


def sets_of(docs: DataFrame, n: int, needed: DataFrame) -> DataFrame:
    """(cls, data) of the classes in `needed`; data: the sorted hashes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column("text"), n))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "data"])

    own, _ = _texts_of(docs, needed)
    return saved(own.mapInArrow(run, "cls long, data binary").dropDuplicates(["cls"]), "sets")


def sifted(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may be linked by their sketches."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = zip(b.column("x"), b.column("nx").to_pylist(), b.column("y"), b.column("ny").to_pylist(), strict=True)
            ok = [possible(np.frombuffer(x.as_py(), "u1"), nx, np.frombuffer(y.as_py(), "u1"), ny, num, den) for x, nx, y, ny in cols]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sketches.select(F.col("cls").alias("a"), F.col("size").alias("nx"), F.col("data").alias("x"))
    y = sketches.select(F.col("cls").alias("b"), F.col("size").alias("ny"), F.col("data").alias("y"))
    near = den * F.least("nx", "ny") >= num * F.greatest("nx", "ny")
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "x", "nx", "y", "ny").mapInArrow(run, "a long, b long")


def checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_py(), "uint64"), np.frombuffer(y.as_py(), "uint64"), num, den) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("cls").alias("a"), F.col("data").alias("x")), sets.select(F.col("cls").alias("b"), F.col("data").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _met(num: int, den: int, nearest: bool):
    """Of rows (sig, cls, root, size, data) sorted by sig: for each class a of a group those above it that have another root
    and may be linked with it by their bitmaps. Packed in rows (a, others), or nearest: only the one of greatest bound of
    similarity, as rows (a, b, bound)."""
    names = ["a", "b", "bound"] if nearest else ["a", "others"]

    def compared(group: list[pa.RecordBatch]) -> Iterator[tuple]:
        t = pa.Table.from_batches(group)
        cls, root, size = (t.column(c).to_numpy() for c in ("cls", "root", "size"))
        if (root == root[0]).all():
            return
        order, data = np.argsort(cls), t.column("data").to_pylist()
        width = min(map(len, data))
        bits = np.stack([np.bitwise_or.reduce(np.frombuffer(data[i], "u1").reshape(-1, width), 0) for i in order]).view("uint64")
        cls, root, size = cls[order], root[order], size[order]
        for i in range(len(cls) - 1):
            j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (den * np.minimum(size[i + 1 :], size[i]) >= num * np.maximum(size[i + 1 :], size[i])))
            if len(j):
                x, y = bits[i], bits[j]
                both = np.minimum(size[i] - np.bitwise_count(x & ~y).sum(1, "int64"), size[j] - np.bitwise_count(y & ~x).sum(1, "int64"))
                either = size[i] + size[j] - both
                able = den * both >= num * either
                if able.any():
                    if nearest:
                        bound = np.where(able, both / either, 0)
                        best = int(bound.argmax())
                        yield int(cls[i]), int(cls[j[best]]), float(bound[best])
                    else:
                        yield int(cls[i]), cls[j[able]].tobytes()

    def record(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64()) if nearest else (pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []
        for b in batches:
            sig = b.column("sig").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])).tolist() if len(sig) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if group and sig[x] != now:
                    out += compared(group)
                    group = []
                now = sig[x]
                group.append(b.slice(x, y - x))
            if len(out) > 1000:
                yield record(out)
                out = []
        if group:
            out += compared(group)
        if out:
            yield record(out)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, others) sorted by a: the distinct pairs (a, b)."""

    def pairs() -> pa.RecordBatch:
        b = np.unique(np.frombuffer(b"".join(held), "int64"))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), now, "int64")), pa.array(b)], names=["a", "b"])

    now, held = None, []
    for batch in batches:
        for a, others in zip(batch.column("a").to_pylist(), batch.column("others").to_pylist(), strict=True):
            if a != now and held:
                yield pairs()
                held = []
            now = a
            held.append(others)
    if held:
        yield pairs()


def _in_groups(groups: DataFrame, sketches: DataFrame, roots: DataFrame, parts: int, num: int, den: int, nearest: bool) -> DataFrame:
    """What _met finds in groups (sig, cls) of bounded size."""
    rows = groups.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("root", "cls").alias("root")).join(sketches, "cls")
    dealt = rows.select("sig", "cls", "root", "size", "data").repartition(parts, "sig").sortWithinPartitions("sig")
    return dealt.mapInArrow(_met(num, den, nearest), "a long, b long, bound double" if nearest else "a long, others binary")


def nearest_pairs(groups: DataFrame, sketches: DataFrame, roots: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b), one a class at most: of the classes that share a group with it and have another root, the one that may
    be most similar by its bitmap."""
    found = _in_groups(groups, sketches, roots, parts, num, den, True)
    return found.groupBy("a").agg(F.max(F.struct("bound", "b")).alias("x")).select("a", "x.b")


def group_pairs(groups: DataFrame, sketches: DataFrame, roots: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of different roots that share a group and may be linked by their bitmaps. They stay packed,
    a row a class and group, until they are distinct."""
    met = _in_groups(groups, sketches, roots, parts, num, den, False)
    return met.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_merged, "a long, b long")


def prefix_pairs(sets: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of different roots that may be linked: each pair shares a shingle among the first
    size - ceil(threshold * size) + 1 of both, in one order that puts frequent shingles last, at places that leave room for
    the overlap that a link takes."""
    own = saved(sets.join(roots, sets["cls"] == roots["node"], "left").select("cls", F.coalesce("root", "cls").alias("root"), "data"), "own")

    @tidy
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("data"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), "int64"))], names=["token"])

    often = saved(own.select("data").mapInArrow(tokens, "token long").groupBy("token").count().where("count >= 8"), "often")
    least = 8
    while often.where(F.col("count") >= least).count() > BROADCAST_ROWS:
        least *= 2
    # At most BROADCAST_ROWS tokens; all others count as rare, which changes the order but not what is found.
    hot = often.where(F.col("count") >= least).orderBy("token").toPandas()
    hot_tokens, hot_counts = hot["token"].to_numpy("int64"), hot["count"].to_numpy("int64")

    @tidy
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, root, data in zip(b.column("cls"), b.column("root"), b.column("data"), strict=True):
                t = np.frombuffer(data.as_py(), "int64")
                n = np.zeros(len(t), "int64")
                if len(hot_tokens):
                    at = np.minimum(np.searchsorted(hot_tokens, t), len(hot_tokens) - 1)
                    n = np.where(hot_tokens[at] == t, hot_counts[at], 0)
                first = t[np.lexsort((t, n))][: len(t) - -(-len(t) * num // den) + 1]
                same = lambda v: pa.array(np.full(len(first), v, "int64"))
                place = pa.array(np.arange(1, len(first) + 1))
                yield pa.RecordBatch.from_arrays([same(cls.as_py()), same(root.as_py()), same(len(t)), place, pa.array(first)], names=["cls", "root", "size", "place", "token"])

    rows = saved(own.mapInArrow(prefixes, "cls long, root long, size long, place long, token long"), "prefixes")
    side = lambda k: rows.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("cls", "root", "size", "place")))
    x, y = side("a").withColumnRenamed("cls_a", "a"), side("b").withColumnRenamed("cls_b", "b")
    near = (F.col("root_a") < F.col("root_b")) & (den * F.least("size_a", "size_b") >= num * F.greatest("size_a", "size_b"))
    # If this is the first shingle that both have in that order, no more than those after it can follow.
    near = near & ((num + den) * (1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))) >= num * (F.col("size_a") + F.col("size_b")))
    return x.join(y, "token").where(near).select("a", "b").distinct()


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, cls, component_id): per row its set's class and the least doc_id that links reach."""
    return _joined(docs, n, num, den).select("doc_id", "n_shingles", "cls", "component_id")


def _joined(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, key, n_shingles, cls, component_id, component): `component` is a class, which rows without an id have too."""
    spark = docs.sparkSession
    rows = saved(classes(docs, n), "classes")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 0.6 / SHARD))
    one = saved(rows.where("cls is not null").groupBy("cls").agg(_first().alias("x")).select("cls", "x.doc_id", "x.key"), "one")
    star = saved(stars(docs, n, num, den, parts), "stars")
    sketches = sketches_of(docs, n, one.join(_ends(star.select(F.col("member").alias("a"), F.col("leader").alias("b"))), "cls", "left_semi"))
    links = saved(_check(docs, n, one, saved(_leaders(star), "pairs"), sketches, num, den), "links")
    roots = saved(components(links), "roots")
    groups, _ = _open_groups(star, roots)
    # Large groups are looked at in slices here.
    slice_ = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / MOST))
    groups = groups.select(F.when(F.col("n") > MOST, F.xxhash64("sig", slice_)).otherwise(F.col("sig")).alias("sig"), "cls")
    links = saved(_exact(docs, n, one, saved(nearest_pairs(groups, sketches, roots, parts, num, den), "nearest"), num, den), "links")
    roots = saved(components(_contracted(roots, links)), "roots")
    groups, large = _open_groups(star, roots)
    more = group_pairs(groups.where(F.col("n") <= MOST), sketches, roots, parts, num, den)
    if large:
        left = saved(groups.where(F.col("n") > MOST).select("cls").distinct(), "left")
        sets = saved(sets_of(docs, n, one.join(left, "cls", "left_semi")), "left_sets")
        more = more.unionByName(_sifted(prefix_pairs(sets, roots, num, den), sketches, num, den)).distinct()
    links = saved(_exact(docs, n, one, saved(more, "more"), num, den), "links")
    if links.limit(1).count():
        roots = saved(components(_contracted(roots, links)), "roots")
    # Least id of each class, then of each component.
    per = one.join(roots, one["cls"] == roots["node"], "left").select("cls", "doc_id", "root")
    least = saved(per.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least").withColumnRenamed("root", "r")
    per = saved(per.join(least, F.col("root") == F.col("r"), "left").select(F.col("cls").alias("c"), F.coalesce("least", "doc_id").alias("least"), F.coalesce("root", "cls").alias("component")), "per_class")
    some = rows.where("cls is not null").join(per, F.col("cls") == F.col("c")).select("doc_id", "key", "n_shingles", "cls", F.col("least").alias("component_id"), "component")
    return some.unionByName(rows.where("cls is null").select("doc_id", "key", "n_shingles", "cls", F.col("doc_id").alias("component_id"), F.col("cls").alias("component")))


def _first() -> Column:
    """Of rows (doc_id, key) the one of least id; rows without an id come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _rooted(star: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, member, leader, r_member, r_leader): with the roots of both."""
    root = lambda k: roots.select(F.col("node").alias(f"n_{k}"), F.col("root").alias(f"r_{k}"))
    at = star.join(root("member"), F.col("member") == F.col("n_member"), "left").join(root("leader"), F.col("leader") == F.col("n_leader"), "left")
    return at.select("sig", "member", "leader", F.coalesce("r_member", "member").alias("r_member"), F.coalesce("r_leader", "leader").alias("r_leader"))


def _leaders(star: DataFrame) -> DataFrame:
    """Pairs (a, b): each class with one leader, that with which it shares most signatures."""
    per = star.groupBy("member", "leader").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("member").agg(F.max(F.struct("n", "leader")).alias("x")).select(F.col("member").alias("a"), F.col("x.leader").alias("b"))


def _open_groups(star: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """(sig, cls, n): the groups of n classes that are not all connected; and how many of them have more than MOST."""
    sig = _rooted(star, roots).groupBy("sig").agg(F.max(F.col("r_member") != F.col("r_leader")).alias("apart")).where("apart").select("sig")
    some = star.join(sig, "sig", "left_semi")
    some = saved(some.select("sig", F.col("member").alias("cls")).unionByName(some.select("sig", F.col("leader").alias("cls"))).distinct(), "open")
    large = saved(some.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST), "large")
    k = large.count()
    return (some.join(large, "sig", "left").withColumn("n", F.coalesce("n", F.lit(0))) if k else some.withColumn("n", F.lit(0))), k


def _contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links.select("a", "b"))


def _sifted(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may be linked by their sketches, of which only those that are needed are joined."""
    pairs = saved(pairs, "candidates")
    ends = _ends(pairs)
    return sifted(pairs, sketches.join(F.broadcast(ends) if 2 * pairs.count() <= BROADCAST_ROWS else ends, "cls", "left_semi"), num, den)


def _exact(docs: DataFrame, n: int, one: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    return checked(pairs, sets_of(docs, n, one.join(_ends(pairs), "cls", "left_semi")), num, den)


def _check(docs: DataFrame, n: int, one: DataFrame, pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The linked pairs: sifted by sketches, which are a tenth as large as sets, then checked exactly."""
    return _exact(docs, n, one, saved(_sifted(pairs, sketches, num, den), "near"), num, den)


def one_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows that stay, with the columns that came: of each component one row, of least id if any has one, and all
    documents without words. Rows of one id but of other components all have their own."""
    found = saved(_joined(docs, n, num, den).where("cls is not null").groupBy("component", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "joined")
    stays = saved(found.groupBy("component").agg(_first().alias("x")).select(F.col("component").alias("c"), F.col("x.doc_id").alias("d"), F.col("x.key").alias("k")), "stays")
    same = (F.col("component") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    rows = found.join(stays, same, "left").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "n", F.col("c").isNotNull().alias("stays"))
    rows = saved(rows, "rows")

    def small(part: DataFrame) -> DataFrame:
        return F.broadcast(part) if part.count() <= BROADCAST_ROWS else part

    out = docs.join(small(rows.where("not stays").select("__id", "__key")), _same_row(F.col("doc_id")), "left_anti")
    twice = rows.where("stays and n > 1").select("__id", "__key")
    if not twice.limit(1).count():
        return out
    twice = small(twice)
    copies = out.join(twice, _same_row(F.col("doc_id")), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(twice, _same_row(F.col("doc_id")), "left_anti").unionByName(copies)
