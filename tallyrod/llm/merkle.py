"""Merkle manifest of a table: a digest of every row, trees over them by language, and proofs of membership.

A leaf is the sha256 of a row's fields, each with its length in front. Leaves of a language ascend by id; every eight
consecutive nodes become their digest until one is left, the language's subroot; subroots, ordered by language, become
the root in the same way. Built levels are stored as rows that name their parent (tree, level, place in it) and hold
their children's digests. A recursive query then climbs from every leaf to the root: at each node it appends the other
children's digests and folds its own digest, which starts from the leaf under test, into the parent's.

Leaves of one bottom run have all siblings but those in the run in common, so a run of up to eight leaves climbs as one
row that folds each leaf's digest by itself and keeps the common siblings once.

Scale: only digests are shuffled, never texts. Places come from a range partitioning by language and id: rows are
numbered inside a range and ranges are offset by counts, so no language is sorted in one task. The upper levels, where
many leaves meet in few nodes, are at most TOP nodes and are broadcast to the climb; below them it joins by shuffle, and
no node there has many leaves.

Defined cases: a null field is written "-"; null ids come first; rows with one id are ordered by leaf, so repeated rows
have neighbouring leaves of their own; a null language is a language of its own, first; the empty text differs from
null; a lone leaf is its language's subroot and a lone subroot the root; a proof without siblings is the digest of
nothing; an empty table gives an empty result; columns other than the five are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node.
FAN = 8
#: Nodes of upper levels that are broadcast, under 1 KB each.
TOP = 4_096
#: The tree over the subroots; those of languages count from 0.
ABOVE = -1

_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def digest(fields: Sequence[Column]) -> Column:
    """sha256 of the fields: "-" for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def leaves(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, tested: the leaf under test, which is that of the row with `text` in place of its own where
    `tampered` holds."""
    own = [F.col(c) for c in FIELDS]
    tested = F.col("leaf")
    if tampered is not None:
        tested = F.when(tampered, digest([*own[:-1], F.col("text") if text is None else text])).otherwise(tested)
    return docs.select(*FIELDS).withColumn("leaf", digest(own)).select("doc_id", "lang", "leaf", tested.alias("tested"))


def _levels(size: Column) -> Column:
    """Levels above the leaves of a tree: the octal digits of size - 1, none for a single leaf."""
    return F.when(size > 1, F.length(F.conv((size - 1).cast("string"), 10, FAN))).otherwise(0).cast("int")


def placed(rows: DataFrame) -> DataFrame:
    """The leaves with tree (the language's number), idx (place in it, from 0) and height (levels above its leaves)."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    rows = saved(rows, "leaves")
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), F.col("lang").asc_nulls_first(), *order)
    ranged = saved(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    counts = saved(ranged.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("size"))
    # One row a language; of one language as many rows as ranges.
    tree = (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("lang").asc_nulls_first())) - 1).alias("tree")
    sizes = sizes.select(F.col("lang").alias("l"), tree, _levels(F.col("size")).alias("height"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).join(sizes, F.col("lang").eqNullSafe(F.col("l")))
    starts = saved(starts.select(F.col("lang").alias("l"), F.col("part").alias("p"), "before", "tree", "height"), "starts")
    ranged = ranged.join(starts, (F.col("part") == F.col("p")) & F.col("lang").eqNullSafe(F.col("l")))
    inside = F.row_number().over(W.partitionBy("part", "tree").orderBy(*order)) - 1
    return ranged.select("tree", "height", (F.col("before") + inside).alias("idx"), "doc_id", "leaf", "tested")


@dataclass
class Manifest:
    #: tree, idx, height, members (doc_id, leaf, tested; in order): bottom runs of up to FAN leaves.
    runs: DataFrame
    #: tree, level, idx, hash, kids (digests), up_tree, up_level, up_idx, place, step: nodes above the bottom runs.
    nodes: DataFrame
    #: The number of nodes of each step, and the root; None for an empty table.
    steps: dict[int, int]
    root: str | None


def _built(base: DataFrame, most: int) -> list[DataFrame]:
    """The levels above rows (tree, level, idx, hash, height), up to `most`: the same columns with kids."""
    out = []
    for _ in range(most):
        run = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        up = base.where(F.col("level") < F.col("height")).groupBy("tree", "level", F.expr(f"idx div {FAN}").alias("at")).agg(run.alias("run"), F.max("height").alias("height"))
        kids = F.col("run.hash")
        base = saved(up.select("tree", (F.col("level") + 1).alias("level"), F.col("at").alias("idx"), F.sha2(F.array_join(kids, ""), 256).alias("hash"), "height", kids.alias("kids")), "level")
        out.append(base)
    return out


def build(rows: DataFrame) -> Manifest:
    """The trees over leaves (doc_id, lang, leaf, tested). A job for each level; levels shrink by FAN. The driver gets the
    heights, the root, and a number for each level."""
    members = F.array_sort(F.collect_list(F.struct("idx", "doc_id", "leaf", "tested")))
    runs = placed(rows).groupBy("tree", F.expr(f"idx div {FAN}").alias("at")).agg(members.alias("m"), F.max("height").alias("height"))
    runs = saved(runs.select("tree", F.col("at").alias("idx"), "height", F.transform("m", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["tested"].alias("tested"))).alias("members")), "runs")
    most = runs.agg(F.max("height")).first()[0]
    kids = F.col("members.leaf")
    first = F.when(F.col("height") > 0, F.sha2(F.array_join(kids, ""), 256)).otherwise(F.get(kids, 0))
    base = runs.select("tree", F.least("height", F.lit(1)).alias("level"), "idx", first.alias("hash"), "height")
    low = _built(base, max((most or 0) - 1, 0))
    tops = base.where("level = height").select("tree", "hash")
    for level in low:
        tops = tops.unionByName(level.where("level = height").select("tree", "hash"))
    tops = saved(tops, "tops")
    n = tops.count()
    above = len(f"{n - 1:o}") if n > 1 else 0
    high = _built(tops.select(F.lit(ABOVE).alias("tree"), F.lit(0).alias("level"), F.col("tree").cast("long").alias("idx"), "hash", F.lit(above).alias("height")), above)
    root = (high[-1] if high else tops).select("hash").first() if n else None
    stored = None
    for level, lift in [*((x, 0) for x in low), *((x, most) for x in high)]:
        rows = level.select("tree", "level", "idx", "hash", "kids", *_parent(above), (F.col("level") + lift).alias("step"))
        stored = rows if stored is None else stored.unionByName(rows)
    if stored is None:
        stored = base.where("false").withColumn("kids", F.array("hash")).select("tree", "level", "idx", "hash", "kids", *_parent(above), F.col("level").alias("step"))
    nodes = saved(stored, "nodes")
    return Manifest(runs, nodes, {r["step"]: r["n"] for r in nodes.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}, root and root[0])


def _parent(above: int) -> list[Column]:
    """up_tree, up_level, up_idx and place (from 0 among the parent's children) of rows tree, level, idx, height; null for
    the root. A language's last node is also a leaf of the tree over the subroots, if that has levels."""
    inside, over = F.col("level") < F.col("height"), (F.col("tree") >= 0) & F.lit(above > 0)
    either = lambda a, b: F.when(inside, a).when(over, b)
    tree = F.col("tree").cast("long")
    return [
        either(F.col("tree"), F.lit(ABOVE)).alias("up_tree"), either(F.col("level") + 1, F.lit(1)).alias("up_level"),
        either(F.expr(f"idx div {FAN}"), F.expr(f"cast(tree as bigint) div {FAN}")).alias("up_idx"), either(F.col("idx") % FAN, tree % FAN).cast("int").alias("place"),
    ]


_CLIMB = """
with recursive climb(tree, idx, folded, siblings, subroot, up_tree, up_level, up_idx, place) as (
  select tree, idx, folded, siblings, subroot, up_tree, up_level, up_idx, place from {start}
  union all
  select {hint} c.tree, c.idx,
    transform(c.folded, x -> sha2(concat(array_join(slice(n.kids, 1, c.place), ''), x, array_join(slice(n.kids, c.place + 2, {fan}), '')), 256)),
    concat(c.siblings, unhex(array_join(concat(slice(n.kids, 1, c.place), slice(n.kids, c.place + 2, {fan})), ''))),
    case when n.tree = {above} and n.level = 1 then element_at(n.kids, c.place + 1) else c.subroot end,
    n.up_tree, n.up_level, n.up_idx, n.place
  from climb c join {nodes} n on c.up_tree = n.tree and c.up_level = n.level and c.up_idx = n.idx
)
select * from climb where up_tree is null or {beyond}"""


def _climbed(spark: SparkSession, start: DataFrame, nodes: DataFrame, beyond: str, hint: str) -> DataFrame:
    """Rows of `start` after all steps inside `nodes`; beyond: which parents are none of these."""
    old = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")  # else a recursion may not pass a million rows
    try:
        sql = _CLIMB.format(start="{start}", nodes="{nodes}", hint=hint, fan=FAN, above=ABOVE, beyond=beyond)
        return saved(spark.sql(sql, start=start, nodes=nodes), "climbed")
    finally:
        spark.conf.unset(_ROW_LIMIT) if old is None else spark.conf.set(_ROW_LIMIT, old)


def verify(manifest: Manifest, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings from leaf to root, in order), folded_root (from the leaf
    under test and the stored siblings), verified. top: nodes that may be broadcast."""
    runs, nodes, steps = manifest.runs, manifest.nodes, manifest.steps
    spark, most = runs.sparkSession, max([0, *steps])
    cut = next(s for s in range(most + 2) if sum(n for k, n in steps.items() if k >= s) <= top)
    above = nodes.where(F.col("tree") == ABOVE).agg(F.max("level")).first()[0] or 0
    height = runs.agg(F.max("height")).first()[0] or 0
    kids = F.col("members.leaf")
    # The first step is inside the run: each leaf under test among the others.
    fold = F.expr(f"transform(members, (m, i) -> sha2(concat(array_join(slice(members.leaf, 1, i), ''), m.tested, array_join(slice(members.leaf, i + 2, {FAN}), '')), 256))")
    own = runs.withColumn("level", F.least("height", F.lit(1)))
    lone = F.when(F.col("height") == 0, F.get(kids, 0))
    start = own.select("tree", "idx", F.when(F.col("height") > 0, fold).otherwise(F.col("members.tested")).alias("folded"), F.unhex(F.lit("")).alias("siblings"), lone.alias("subroot"), *_parent(above))
    below = nodes.where(F.col("step") < cut)
    if any(k < cut for k in steps):
        start = _climbed(spark, start, below, f"up_level + if(up_tree = {ABOVE}, {height}, 0) >= {cut}", "")
    up = _climbed(spark, start, nodes.where(F.col("step") >= cut), "false", "/*+ broadcast(n) */")
    up = up.select(F.col("tree").alias("t"), F.col("idx").alias("i"), "folded", F.lower(F.hex("siblings")).alias("siblings"), "subroot")
    both = runs.join(up, (F.col("tree") == F.col("t")) & (F.col("idx") == F.col("i")))
    at = F.expr("""inline(transform(members, (m, i) -> named_struct('doc_id', m.doc_id, 'leaf', m.leaf,
      'proof', sha2(concat(array_join(slice(members.leaf, 1, i), ''), array_join(slice(members.leaf, i + 2, size(members)), ''), siblings), 256), 'folded', element_at(folded, i + 1))))""")
    root = F.lit(manifest.root).cast("string")
    return both.select("subroot", at).select("doc_id", "leaf", F.coalesce("subroot", root).alias("subroot"), root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), F.col("folded").eqNullSafe(root).alias("verified"))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The manifest of documents put to the test: where 3 divides the unsigned crc32 of the id, the letters A-Z of the text
    are lower-cased before its leaf is folded again."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return verify(build(leaves(docs, hit, F.translate("text", UPPER, LOWER))), top)
