"""Periodic runs in the words of texts, found by suffix trees.

A run is a stretch of words with smallest period q that no neighbouring word extends; those of at least LEAST words and
TIMES periods are reported, and what repeats a run's first period is cut out. Per text:

1. Each word's distance to its previous occurrence. Inside a run of period q, past its first q words, no distance exceeds
   q. So for each scale Q = 1, 2, 4, ... only stretches of words with distances up to Q that are long enough for periods
   in (Q / 2, Q] matter, with Q + 1 words before and one after. This is a necessary condition, so nothing is lost, and
   most texts end here.
2. Ukkonen's suffix tree of each such stretch and of its reversal, in linear time. A tour of the tree gives the string
   depths on the way from leaf to leaf; the longest common extension of two places is the depth of their leaves' lowest
   common ancestor, a range minimum over the tour, answered by two lookups in the level of a sparse table.
3. The longest Lyndon word from each place, in the order of the words and in the reverse order, gives the candidates:
   every run has one as its root. Each is extended both ways by longest common extensions.

Texts are independent, so nothing is shuffled; a text takes time in proportion to its words, and memory of about 1 KB per
word of the stretches that step 1 leaves, one at a time.

Defined cases: a null or blank text has no words and no runs; repeated rows each get the same result; a null id is never
among the ids whose words repeat (`planted`); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run, and fewest periods.
LEAST, TIMES = 6, 4
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_tree(s: list[int], sigma: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Ukkonen's tree of s, whose last symbol 0 occurs nowhere else; symbols are below sigma. Edges: node * sigma + first
    symbol -> child; where each node's edge starts and ends in s; the suffix of each leaf, -1 for inner nodes."""
    n = len(s)
    edges: dict[int, int] = {}
    start, end, link, suffix = [0], [0], [0], [-1]
    node = length = first = open_ = 0
    for i, c in enumerate(s):
        open_ += 1
        inner = 0  # the node that waits for its suffix link
        while open_:
            if not length:
                first = i
            key = node * sigma + s[first]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                suffix.append(i - open_ + 1)
                if inner:
                    link[inner] = node
                    inner = 0
            else:
                at = start[child]
                size = end[child] - at
                if length >= size:
                    first += size
                    length -= size
                    node = child
                    continue
                if s[at + length] == c:
                    length += 1
                    if inner:
                        link[inner] = node
                    break
                split = len(start)
                edges[key] = split
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                suffix += (-1, i - open_ + 1)
                start[child] = at + length
                edges[split * sigma + c] = split + 1
                edges[split * sigma + s[at + length]] = child
                if inner:
                    link[inner] = split
                inner = split
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                first = i - open_ + 1
    return edges, start, end, suffix


class Extensions:
    """Longest common extensions of places in s, and the order of its suffixes."""

    def __init__(self, s: np.ndarray):
        """s: symbols from 1 on."""
        self.n = len(s)
        sigma = int(s.max()) + 1
        edges, start, end, suffix = suffix_tree([*s.tolist(), 0], sigma)
        self.suffix = np.array(suffix)
        keys = np.fromiter(edges.keys(), "int64", len(edges))
        child = np.fromiter(edges.values(), "int64", len(edges))
        parent, symbol = keys // sigma, keys % sigma
        size = np.array(end) - np.array(start)
        up = np.lexsort((symbol, parent))
        self._tour(child[up], parent[up], size)
        # The same tree with other children's order: the end first, then falling symbols.
        down = np.lexsort((np.where(symbol, -symbol, -sigma), parent))
        self.falling = self._ranks(child[down], parent[down])

    def _tour(self, child: np.ndarray, parent: np.ndarray, size: np.ndarray) -> None:
        first = np.searchsorted(parent, np.arange(len(size) + 1)).tolist()
        kids, sizes, suffix = child.tolist(), size.tolist(), self.suffix.tolist()
        depths, where, rank = [], [0] * (self.n + 1), []
        stack = [(0, first[0], 0)]
        while stack:  # the depth of a node is noted whenever the tour comes to it
            node, k, depth = stack.pop()
            depths.append(depth)
            if k < first[node + 1]:
                stack.append((node, k + 1, depth))
                below = kids[k]
                if suffix[below] < 0:
                    stack.append((below, first[below], depth + sizes[below]))
                else:
                    where[suffix[below]] = len(depths)
                    rank.append(suffix[below])
                    depths.append(depth + sizes[below])
        self.depths, self.where = np.array(depths, "int32"), np.array(where)
        self.rising = np.empty(self.n + 1, "int64")
        self.rising[rank] = np.arange(self.n + 1)

    def _ranks(self, child: np.ndarray, parent: np.ndarray) -> np.ndarray:
        first = np.searchsorted(parent, np.arange(len(self.suffix) + 1)).tolist()
        kids, suffix, order, stack = child.tolist(), self.suffix.tolist(), [], [0]
        while stack:
            node = stack.pop()
            if suffix[node] < 0:
                stack += kids[first[node] : first[node + 1]][::-1]
            else:
                order.append(suffix[node])
        out = np.empty(self.n + 1, "int64")
        out[order] = np.arange(self.n + 1)
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal, for pairs of different places up to n."""
        a, b = self.where[i], self.where[j]
        left, right = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((right - left + 1).astype("float64"))[1] - 1
        out, low = np.empty(len(left), "int64"), self.depths
        for k in range(int(level.max(initial=-1)) + 1):  # low: least depth from each place on over 2**k places
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(low[left[own]], low[right[own] - (1 << k) + 1])
            if len(low) > 1 << k:
                low = np.minimum(low[: -(1 << k)], low[1 << k :])
        return out


def _lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place ends: at the next suffix of lower rank."""
    r, out, stack = rank.tolist(), [0] * (len(rank) - 1), []
    for i, x in enumerate(r):
        while stack and r[stack[-1]] > x:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def maximal_runs(s: np.ndarray) -> np.ndarray:
    """(start, length, period), sorted by start and period, of all runs of s with at least two periods that are long enough
    to be reported; symbols count from 1."""
    n = len(s)
    tree, back = Extensions(s), Extensions(s[::-1])
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([_lyndon_ends(tree.rising), _lyndon_ends(tree.falling)])
    left, right = back.lce(n - i, n - j), tree.lce(i, j)
    runs = np.stack([i - left, j + right - i + left, j - i], 1)
    runs = runs[(runs[:, 1] >= LEAST) & (runs[:, 1] >= TIMES * runs[:, 2])]
    return np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches of words outside of which no reported run has a word, nor its neighbours."""
    n = len(ids)
    order = np.argsort(ids.astype("uint16") if n < 1 << 16 else ids, kind="stable")
    before = np.full(n, n)
    again = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][again]] = (order[1:] - order[:-1])[again]
    out, q, most = [], 1, n // TIMES
    while q // 2 < most:
        least = q // 2 + 1  # the smallest period of this scale
        need = max(LEAST, TIMES * least) - least
        bounds = np.concatenate(([-1], np.flatnonzero(before > q), [n]))
        for k in np.flatnonzero(np.diff(bounds) > need).tolist():
            out.append((max(0, int(bounds[k]) - q), min(n, int(bounds[k + 1]) + 1)))
        q *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def runs_of(words: list[bytes]) -> np.ndarray:
    """(start, length, period) of the reported runs, sorted by start and period."""
    n, known = len(words), {}
    found = [np.empty((0, 3), "int64")]
    if n >= LEAST:
        ids = np.array([known.setdefault(w, len(known)) for w in words])
        for a, b in _stretches(ids):
            own = maximal_runs(np.unique(ids[a:b], return_inverse=True)[1] + 1)
            # A run of the text lies inside; what meets the stretch's edge is cut off by it.
            whole = ((own[:, 0] > 0) | (a == 0)) & ((own[:, 0] + own[:, 1] < b - a) | (b == n))
            found.append(own[whole] + [a, 0, 0])
    return np.concatenate(found)


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words of an id with crc32 h: if 10 divides h, those from a place on repeat the first of them."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run holds past its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, "int64")
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _row(text: str | None, h: int | None) -> tuple:
    words = (text or "").encode("utf-8", "replace").split()
    if h is not None:
        words = planted(words, h)
    runs = runs_of(words)
    rows = runs.tolist()
    best = (None,) * 4
    if rows:
        top = rows[0]
        for r in rows[1:]:
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = (*top, 1000 * top[1] // top[2])
    said = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    return len(rows), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.
    plant: texts of a tenth of the ids are made periodic first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
        names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")[1:])]
        for b in batches:
            rows = [_row(t.as_py(), zlib.crc32(str(i.as_py()).encode()) if plant and i.is_valid else None) for i, t in zip(b.column("doc_id"), b.column("text"), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
