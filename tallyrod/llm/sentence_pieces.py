"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

A text is escaped as the model's own normalizer does (blanks become U+2581, one more goes in front) and parted into
marked words, each a run of marks and what follows it, also before line feeds where no piece holds one. No piece crosses
these places, so the best segmentation of a text joins the best ones of its words. Each task sorts the distinct words
that it has not met yet and walks them like a trie, depth first: a word keeps the forward scores of the prefix that
it shares with the word before and computes only those of its own letters.

The segmentation is the one of greatest total score under the file's scores, with the longer first piece where two
are equal: what the unigram algorithm finds. (For a file trained by merges this can differ from replaying the merges.)
Characters without a piece become their UTF-8 bytes.

Defined cases: null stays null when encoded and decoded; the empty text has no pieces; U+2581 in a text decodes as a
blank; unpaired surrogates cannot occur in Spark strings; very long words take memory in proportion to their length;
repeated rows are encoded alike; other columns are kept, but one with the new column's name is replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

MARK = "▁"
#: Entries of one generation of a worker's memory of segmented words; it keeps two.
MEMORY = 300_000

_models: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if len(n.precompiled_charsmap) or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("only models with the identity normalizer and a leading mark")
        kinds = pb.ModelProto.SentencePiece
        self.text = [b""] * len(proto.pieces)
        self.bytes = [0] * 256
        # Pieces by their letters from last to first; under "" the id and score of the piece that ends the walk.
        self.tree: dict = {}
        lowest, multi = 0.0, False
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.text[i] = p.piece.encode()
                node = self.tree
                for c in reversed(p.piece):
                    node = node.setdefault(c, {})
                node[""] = (i, p.score)
                lowest, multi = min(lowest, p.score), multi or "\n" in p.piece
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("a piece crosses words")
        self.unknown = lowest - 10
        self.words = re.compile(f"{MARK}+[^{MARK}]*" if multi else f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
        self.memory: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) for each of the words, which come sorted."""
        last, best, back = "", [0.0], [(0, 0)]
        tree, unknown = self.tree, self.unknown
        for w in words:
            shared, most = 0, min(len(last), len(w))
            while shared < most and last[shared] == w[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                top, how = best[end - 1] + unknown, (end - 1, -1)
                node, at = tree.get(w[end - 1]), end - 1
                while node is not None:
                    if "" in node:
                        score = best[at] + node[""][1]
                        if score >= top:  # later ones are longer
                            top, how = score, (at, node[""][0])
                    at -= 1
                    if at < 0:
                        break
                    node = node.get(w[at])
                best.append(top)
                back.append(how)
            ids, at = [], len(w)
            while at:
                start, piece = back[at]
                if piece < 0:
                    ids += [self.bytes[b] for b in reversed(w[start:at].encode("utf-8", "replace"))]
                else:
                    ids.append(piece)
                at = start
            last = w
            yield w, ids[::-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        cut = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.memory) > MEMORY:
            self.old, self.memory = self.memory, {}
        missing = set().union(*cut).difference(self.memory)
        known = missing.intersection(self.old)
        self.memory.update((w, self.old[w]) for w in known)
        for w, ids in self.segment(sorted(missing.difference(known))):
            self.memory[w] = array("i", ids).tobytes()
        return [b"".join(map(self.memory.__getitem__, ws)) for ws in cut]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


def _pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """Adds the array of piece ids; an old column `into` goes."""
    if into == text:
        raise ValueError("the pieces need a column of their own")
    docs = docs.drop(into)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                texts = b.column(text).to_pylist()
                ids = pieces.encode([t or "" for t in texts])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("int32")
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield b.append_column(into, pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([t is None for t in texts])))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, model: str, ids: str = "pieces", into: str = "decoded") -> DataFrame:
    """Adds the text that the pieces spell; an old column `into` goes."""
    if into == ids:
        raise ValueError("the text needs a column of its own")
    docs = docs.drop(into)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                yield b.append_column(into, pa.array([None if x is None else pieces.decode(x) for x in b.column(ids).to_pylist()], pa.string()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), same (the decoded text is the text; null
    for null)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                texts = b.column("text").to_pylist()
                ids = pieces.encode([t or "" for t in texts])
                back = [pieces.decode(array("i", x)) for x in ids]
                same = [None if t is None else t.replace(MARK, " ") == x for t, x in zip(texts, back, strict=True)]
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) if x else 0 for x in ids], pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_pieces", "ids_crc32", "same"])

    # One pass over each text; encode() and decode() as two steps would carry all ids through the JVM.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, same boolean")
