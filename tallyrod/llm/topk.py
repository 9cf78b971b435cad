"""Exact top-k by inner product with block-at-a-time pruning.

Components become floor(64 * x). Equal vectors form a class, whose scores tie with every query: the class asks once,
and only as many of its rows are searched, by id, as one list can hold. The rows are put in an order that brings similar vectors together (sign bits, then id) and
cut into groups, one a partition, and these into blocks of consecutive rows. A block keeps its forward index (its
vectors) and each term's largest and least value; the sum over a query's terms of the better of both times the query's
weight bounds every score in the block.

A query is scored against PILOT rows spread over the table and then in its own group, which gives a threshold: its k-th
score so far. The k-th score of any rows is a sure threshold, so the pilot changes no result. The query is then sent only to groups
whose bound reaches the threshold. There it takes blocks by its own falling bounds until one is below its k-th score. Each
group is held once, by one task, and queries stream past it in batches; partial lists of at most k meet at the end,
where each query takes its class's list without its own rows. Lists are longer by the rows of one id, so k others stay.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; shorter vectors count
as ending in zeros; ties go to the smaller id; rows of one id are not each other's candidates and ask together; repeated
rows are candidates each; fewer than k others give all of them; rows without an id take no part; an empty table gives an empty result; other columns are not read.
Scores are exact 64-bit integers; where one that belongs to the result passes 2**63 the job stops with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

SCALE = 64
BLOCK = 256
#: Rows of a group: what one task holds.
GROUP = 20_000
#: Rows, drawn by a hash, that give queries a first threshold (at most twice as many).
PILOT = 4_096
#: Queries that go together.
BATCH = 512
KEY_BITS = 10
#: Stands for no score; scores are above it.
NONE = -(2**63)
#: Stands for a score beyond 64 bits, as a large vector may have with itself.
FAR = 2**63 - 1

_ROW = "kind string, grp int, ids binary, data binary, floor binary, width int, query_id long, vec_id long, score long"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _record(rows: list[dict]) -> pa.RecordBatch:
    kinds = dict(zip(_NAMES, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()], names=_NAMES)


def _found(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    n = len(q)
    return pa.RecordBatch.from_arrays([pa.array(["found"] * n, pa.string()), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(3)), pa.nulls(n, pa.int32()), pa.array(q), pa.array(v), pa.array(s)], names=_NAMES)


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as 64-bit integers: by doubles where these are exact, which the sum of |a| times the greatest |b| of each
    term tells for each row, else by integers. These are right modulo 2**64, and so right wherever the sum itself is below
    2**63; beyond it the sum becomes FAR or -FAR."""
    most = np.abs(a) @ np.abs(b).max(0, initial=0)
    sums = a @ b.T
    wide = np.flatnonzero(most >= 2**53)
    if not len(wide):
        return sums.astype("int64")
    if max(np.abs(a).max(), np.abs(b).max()) >= 2.0**63:
        raise ValueError("a component passes 2**63")
    far = np.abs(sums) >= 2.0**63 * (1 - 1e-9)
    out = np.where(far, 0, sums).astype("int64")
    out[wide] = a[wide].astype("int64") @ b.astype("int64").T
    return np.where(far, np.where(sums > 0, FAR, -FAR), out)


class Group:
    """The blocks of one group."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        cuts = range(0, len(ids), BLOCK)
        self.blocks = [slice(a, min(a + BLOCK, len(ids))) for a in cuts]
        self.high = np.stack([vectors[b].max(0) for b in self.blocks])
        self.low = np.stack([vectors[b].min(0) for b in self.blocks])

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all that can be among a query's k best, and the new floors. floor: a score that
        the k-th best reaches surely, NONE if unknown. Each query takes its own blocks by falling bound and stops at the first
        that is below its floor; queries whose turn it is at one block are multiplied together."""
        bounds = bound(queries, self.high, self.low)
        turns = np.argsort(-bounds, 1, kind="stable")
        best = np.repeat(floor[:, None], k, 1)  # scores, unordered; floors stand for k unknown ones
        got: list[tuple[np.ndarray, ...]] = []
        floor, on = floor.copy(), np.arange(len(ids))
        for turn in range(len(self.blocks)):
            on = on[bounds[on, turns[on, turn]] >= floor[on]]
            if not len(on):
                break
            for b in np.unique(turns[on, turn]).tolist():
                now, cut = on[turns[on, turn] == b], self.blocks[b]
                scores = _exact(queries[now], self.vectors[cut])
                both = np.concatenate([best[now], scores], 1)
                best[now] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
                floor[now] = best[now].min(1)
                q, v = np.nonzero(scores >= floor[now][:, None])
                got.append((now[q], self.ids[cut][v], scores[q, v]))
        if not got:
            none = np.empty(0, "int64")
            return none, none, none, floor
        q, v, s = map(np.concatenate, zip(*got, strict=True))
        keep = s >= floor[q]
        q, v, s = q[keep], v[keep], s[keep]
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        return ids[q[at < k]], v[at < k], s[at < k], floor


def bound(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """At least the inner product of each query with anything between low and high. Doubles err below 1 here; the sums
    are raised by a share that covers it."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    out = up @ high.T + down @ low.T
    return out + 1e-12 * (up @ np.abs(high).T - down @ np.abs(low).T)


def floors(queries: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among some rows, NONE if these are fewer."""
    if len(rows) < k:
        return np.full(len(queries), NONE)
    return np.partition(_exact(queries, rows), len(rows) - k, 1)[:, -k]


def _pack(ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray | None = None) -> dict:
    return {"ids": ids.tobytes(), "data": vectors.tobytes(), "floor": None if floor is None else floor.tobytes(), "width": vectors.shape[1]}


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    ids = np.frombuffer(r["ids"], "int64")
    return ids, np.frombuffer(r["data"]).reshape(len(ids), r["width"]), None if r["floor"] is None else np.frombuffer(r["floor"], "int64")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `queries` holds, against all other rows."""
    spark = vectors.sparkSession
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(math.inf)))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = saved(rows.groupBy("id", "x").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks")), "rows")
    copies = F.least("n", F.lit(k))
    own = rows.groupBy("id").agg(F.sum(copies).alias("n")).agg(F.max("n")).first()[0] or 0
    most = k + own  # of these at most `own` are the query's
    place = F.row_number().over(W.partitionBy("x").orderBy("id"))  # Spark cuts to `most` before the shuffle, too
    kept = rows.select("id", "x", F.explode(F.sequence(F.lit(1), copies.cast("int")))).withColumn("place", place).where(F.col("place") <= most)
    asked = rows.where("asks").select("x", F.lit(True).alias("asked")).distinct()
    # cls: a class's number, with its first row, if any of its rows asks
    cls = F.when((F.col("place") == 1) & F.col("asked"), F.monotonically_increasing_id())
    kept = saved(kept.join(asked, "x", "left").select("id", "x", cls.alias("cls")), "kept")
    bits = [F.when(F.coalesce(F.get("x", i), F.lit(0.0)) >= 0, F.lit(1 << (KEY_BITS - 1 - i))).otherwise(0) for i in range(KEY_BITS)]
    key = bits[0]
    for b in bits[1:]:
        key = key + b
    shape = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    width = shape["width"] or 1
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shape["n"] / group))

    drawn = F.pmod(F.xxhash64("id", "x"), F.lit(math.ceil(shape["n"] / PILOT) or 1)) == 0
    pilot = _matrix([r["x"] for r in kept.where(drawn).select("x").limit(2 * PILOT).collect()], width)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), list(batches)
        ids = np.concatenate([b.column("id").to_numpy() for b in held]) if held else np.empty(0, "int64")
        if not len(ids):
            return
        asks = np.concatenate([b.column("cls").is_valid().to_numpy(zero_copy_only=False) for b in held])
        cls = np.concatenate([b.column("cls").fill_null(-1).to_numpy() for b in held])
        data = np.concatenate([_matrix([v.values.to_numpy() for v in b.column("x")], width) for b in held if b.num_rows])
        own = Group(ids, data)
        yield _record([{"kind": "group", "grp": part} | _pack(ids, data, np.concatenate([own.high.max(0), own.low.min(0)]))])
        asked = np.flatnonzero(asks)
        for at in range(0, len(asked), BATCH):
            some = asked[at : at + BATCH]
            q, v, s, floor = own.search(cls[some], data[some], floors(data[some], pilot, most), most)
            yield _found(q, v, s)
            yield _record([{"kind": "batch", "grp": part} | _pack(cls[some], data[some], floor)])

    made = saved(kept.withColumn("key", key).repartitionByRange(groups, "key", "id").sortWithinPartitions("key", "id").mapInArrow(index, _ROW), "index")
    # One row a group: its number and the bounds of its terms.
    ends = {r["grp"]: np.frombuffer(r["floor"]).reshape(2, -1) for r in made.where("kind = 'group'").select("grp", "floor").collect()}
    numbers = sorted(ends)
    high, low = (np.stack([ends[j][i] for j in numbers]) if ends else np.zeros((0, width)) for i in (0, 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, data, floor = _unpack(r)
                able = bound(data, high, low) >= floor[:, None]
                for i, j in enumerate(numbers):
                    if j != r["grp"] and able[:, i].any():
                        on = able[:, i]
                        yield _record([{"kind": "sent", "grp": j} | _pack(ids[on], data[on], floor[on])])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids, data, floor = _unpack(r)
                if r["kind"] == "group":
                    now, own = r["grp"], Group(ids, data)
                elif r["grp"] == now:
                    yield _found(*own.search(ids, data, floor, most)[:3])

    sent = made.where("kind = 'batch'").mapInArrow(send, _ROW).unionByName(made.where("kind = 'group'"))
    more = sent.repartition(groups, "grp").sortWithinPartitions("grp", "kind").mapInArrow(search, _ROW)  # "group" sorts before "sent"
    found = made.where("kind = 'found'").unionByName(more).select(F.col("query_id").alias("cls"), "vec_id", "score")
    best = F.desc("score"), "vec_id"
    lists = found.withColumn("rank", F.row_number().over(W.partitionBy("cls").orderBy(*best))).where(F.col("rank") <= most)
    lists = lists.groupBy("cls").agg(F.collect_list(F.struct("vec_id", "score")).alias("list"))
    # Keyed by vector, then by class: a class with many queries is left to the adaptive plan to split.
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "x").join(kept.where("cls is not null").select("x", "cls"), "x").drop("x")
    out = asking.join(lists, "cls").select("query_id", F.inline("list")).where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*best))
    sure = F.when(F.abs("score") == FAR, F.raise_error(F.lit("a score passes 2**63"))).otherwise(F.col("score"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", sure.cast("long").alias("score"))
