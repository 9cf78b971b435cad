"""Personal data: base patterns, and contexts bootstrapped from them.

Base spans of each kind are found by regular expressions in whole texts. They are the seeds of a bootstrap: the words
around an entity make lexical patterns (the two words before it; the word before and the word after), and each other
token or run of digit groups that looks like an identifier is a candidate instance. Patterns and instances form a graph. In each round Spark
scores every pattern of a kind by the share of its distinct instances that are known to be of that kind, keeps those
with enough known instances, and scores each candidate by 1 - product of (1 - score) over the kept patterns around it;
candidates above the threshold are known from then on. Spans of accepted candidates are added, base spans stay.

Defined cases: a null text is empty and has no spans; repeated rows each get the same spans; rows with a null id are
handled like others; texts of any length are scanned whole; an empty table gives an empty result; of the input only
doc_id and text are read, and `redact` returns the columns that came.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Emails and addresses are found by the same rules in one pass over a text, since
#: a search by pattern takes time in the square of a long run of letters or digits.
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+    ip [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rounds of the bootstrap; None: until a round accepts nothing new.
ROUNDS: int | None = None
#: A pattern is kept with so many distinct known instances and such a share of all its instances; a candidate with such a score.
LEAST_KNOWN, LEAST_SHARE, LEAST_SCORE = 5, 0.5, 0.9
#: A candidate holds at least so many characters, of which so many are digits.
LEAST_LENGTH, LEAST_DIGITS = 7, 4

#: Rows that gained spans are broadcast up to so many; beyond that they are joined by shuffle.
BROADCAST_ROWS = 200_000

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
#: Groups of digits that blanks, dots, dashes or brackets join; marks of an address. A run begins where a group does and
#: no group is given back, so that a search takes time in proportion to the text.
_RUN = re.compile(r"\+?\(?(?<![0-9])[0-9]++(?:[\x20.()-]{1,3}+[0-9]++)++")
_AT = re.compile(r"@|\([aA][tT]\)")
_EDGE = ".,;:!?\"'()[]{}<>="
SPAN = "array<struct<kind:int,start:int,end:int>>"
CANDIDATE = "array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    first, at = 0, t.find("@")
    while at >= 0:
        a = at
        while a > first and t[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(t, at + 1) if a < at else None
        if m:
            yield a, m.end()
        first = m.end() if m else at + 1
        at = t.find("@", first)


def _ips(t: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(t):
        if "." not in m.group():
            continue
        parts, at, i = m.group().split("."), [m.start()], 0
        for p in parts:
            at.append(at[-1] + len(p) + 1)
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if not all(four):
                i += 1
                continue
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at[i], at[i + 4] - 1
            i += 4


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end), sorted by start and then by kind; kinds may overlap each other."""
    t = text or ""
    out = [(0, a, b) for a, b in _emails(t)] if "@" in t else []
    if _DIGITS.search(t):
        if "." in t:
            out += [(1, a, b) for a, b in _ips(t)]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in t:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _before(t: str, at: int) -> list[str]:
    """The two words before a place, folded, without their outer punctuation; tokens of punctuation only are no words. A
    short look back suffices: longer words make no pattern."""
    return [w for x in _TOKEN.findall(t[max(0, at - 80) : at]) if (w := x.strip(_EDGE).lower())][-2:]


def _patterns(t: str, a: int, b: int) -> list[str]:
    left = _before(t, a)
    right = next((w for m in _TOKEN.finditer(t, b, b + 60) if (w := m.group().strip(_EDGE).lower())), "")
    out = []
    if len(left) == 2 and all(left):
        out.append(f"{left[0]} {left[1]} _")
    if left and left[-1] and right:
        out.append(f"{left[-1]} _ {right}")
    return out


def instances(text: str | None, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base entities (with their kind) and candidates (kind -1) that have a pattern around them. A candidate
    overlaps no base span. It is a token without its outer punctuation that holds digits enough or a mark of an address
    inside, or a run of groups of digits; a token in a run is one too."""
    t = text or ""
    out = [{"kind": k, "start": a, "end": b, "instance": t[a:b].lower(), "patterns": _patterns(t, a, b)} for k, a, b in base]
    starts, stops = [], []  # base spans that overlap are taken as one
    for _, a, b in base:
        if stops and a < stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    free = lambda a, b: (i := bisect.bisect_left(starts, b)) == 0 or stops[i - 1] <= a
    places = set()
    for marks in (_DIGITS, _AT):
        seen = 0
        for m in marks.finditer(t):
            if m.start() < seen:
                continue
            a = m.start()
            while a > 0 and not t[a - 1] in " \t\n\x0b\x0c\r":
                a -= 1
            seen = _TOKEN.match(t, a).end()
            token = t[a:seen]
            a += len(token) - len(token.lstrip(_EDGE))
            token = token.strip(_EDGE)
            x = _AT.search(token) if marks is _AT else None
            address = x and 0 < x.start() and x.end() < len(token)
            if len(token) >= LEAST_LENGTH and (address or len(_DIGITS.findall(token)) >= LEAST_DIGITS):
                places.add((a, a + len(token)))
    places.update(m.span() for m in _RUN.finditer(t) if m.end() - m.start() >= LEAST_LENGTH and len(_DIGITS.findall(m.group())) >= LEAST_DIGITS)
    out += [{"kind": -1, "start": a, "end": b, "instance": t[a:b].lower(), "patterns": _patterns(t, a, b)} for a, b in sorted(places) if free(a, b)]
    return [x for x in out if x["patterns"]]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of id and text, so repeated rows share it), base spans, instances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        candidate = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for b in batches:
            spans, found = [], []
            for t in b.column("text"):
                t = t.as_py()
                base = base_spans(t)
                spans.append([{"kind": k, "start": x, "end": y} for k, x, y in base])
                found.append(instances(t, base))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(spans, span), pa.array(found, candidate)], names=["doc_id", "key", "base", "instances"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    return own.mapInArrow(run, f"doc_id long, key long, base {SPAN}, instances {CANDIDATE}")


def bootstrapped(scan: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """(key, kind, start, end) of the candidates that the rounds accept."""
    edges = scan.select("key", F.explode("instances").alias("i")).select("key", "i.*").select("key", "kind", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    edges = saved(edges, "edges")
    # The graph: distinct pattern-instance pairs, so a copied text or a common entity counts once.
    graph = saved(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")), "graph")
    known = graph.where("seed >= 0").select("instance", F.col("seed").alias("known")).distinct()
    accepted = None
    for _ in itertools.count() if rounds is None else range(rounds):
        per = graph.join(known, "instance", "left").select("pattern", "instance", "known")
        good = per.groupBy("pattern", F.coalesce("known", F.lit(-1)).alias("kind")).agg(F.count_distinct("instance").alias("n"))
        total = good.groupBy("pattern").agg(F.sum("n").alias("total"))
        good = good.where((F.col("kind") >= 0) & (F.col("n") >= LEAST_KNOWN)).join(total, "pattern")
        good = saved(good.select("pattern", "kind", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= LEAST_SHARE), "good")
        if good.limit(1).count() == 0:
            break
        score = graph.where("seed < 0").select("pattern", "instance").join(good, "pattern").groupBy("instance", "kind").agg(F.round(1 - F.exp(F.sum(F.log(1.000001 - F.col("share")))), 6).alias("score"))  # rounded: sums differ by order
        best = score.where(F.col("score") >= LEAST_SCORE).groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("x")).select("instance", (-F.col("x.minus")).alias("kind"))
        # What was accepted stays, so rounds end.
        now = saved(best if accepted is None else accepted.unionByName(best.join(accepted, "instance", "left_anti")), "accepted")
        if accepted is not None and now.count() == accepted.count():
            accepted = now
            break
        accepted = now
        known = graph.where("seed >= 0").select("instance", F.col("seed").alias("known")).distinct().unionByName(now.select("instance", F.col("kind").alias("known"))).groupBy("instance").agg(F.max("known").alias("known"))
    if accepted is None:
        return edges.where("false").select("key", "kind", "start", "end")
    return edges.where("kind < 0").select("key", "start", "end", "instance").join(accepted, "instance").select("key", "kind", "start", "end").distinct()


def detect(docs: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """doc_id, key, base, more: arrays of (kind, start, end) in code points, end exclusive; kind counts from 0 in KINDS."""
    scan = saved(scanned(docs), "scan")
    more = bootstrapped(scan, rounds).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("more")).withColumnRenamed("key", "k")
    found = scan.join(more, F.col("key") == F.col("k"), "left")
    return found.select("doc_id", "key", "base", F.coalesce("more", F.array().cast(SPAN)).alias("more"))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(by_start, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base spans by kind, their digest, and all spans as text."""
    found = detect(docs)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(n(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "more")).alias("spans"))


def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    out, at, end = [], 0, 0
    for start, _, stop, kind in sorted((a, -b, b, k) for k, a, b in spans):
        if start < end:
            end = max(end, stop)
            at = end
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end = stop
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """The rows that came, their columns too, with every span in the text replaced by its kind. Base spans are found
    where the text is; only rows that gained spans are looked up by key."""
    more = bootstrapped(saved(scanned(docs), "scan"), rounds).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("__s"))
    more = saved(more, "more").withColumnRenamed("key", "__k")
    names, n = docs.columns, more.count()
    if n <= BROADCAST_ROWS:
        more = F.broadcast(more)
    both = docs.join(more, F.xxhash64("doc_id", "text") == F.col("__k"), "left").select(*names, "__s") if n else docs.withColumn("__s", F.lit(None).cast(SPAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, s in zip(b.column("text").to_pylist(), b.column("__s").to_pylist(), strict=True):
                spans = base_spans(t) + [(x["kind"], x["start"], x["end"]) for x in s or ()]
                new.append(cut(t, spans) if spans else t)
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", pa.array(new, b.schema.field("text").type)).select(names)

    return both.mapInArrow(run, docs.schema)
