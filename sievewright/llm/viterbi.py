"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation maximises the sum of piece scores, read as log probabilities; an unknown character costs the least
score less 10 and becomes its bytes. Of equal sums the one found first wins, that is the one whose last piece starts
earliest. Only the last `longest` positions can still be extended: when the backpointer paths of all of them lead through
one boundary, the ids up to there are final and are committed, and what lies before is no longer held.

The start of a run of spaces is always such a boundary, as no piece spans it; stretches between these are encoded once
and kept in a bounded cache, and long texts are never held as lattices.

A Viterbi search maximises scores, which is not how the library encodes with a model file of the BPE kind: for such a
file the ids are those of the best-scoring segmentation, not those of the merges. Decoding gives the text back either
way: U+2581 in a text comes back as a space, which is how the model itself reads it.

Defined cases: null text counts as empty and has no ids; texts of any length; repeated rows are encoded alike.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, ship
from .pieces import LONG, MARK, Pieces, marked, stretches

UNKNOWN_PENALTY = 10.0
#: How many longest pieces are held before the paths' meeting point is looked for.
WINDOWS = 2


class StreamingViterbi:
    """Feed characters with push(), end with finish(); both give the ids that have become final.

    Starts are taken from left to right, each as far as some piece goes on, once the characters of the longest piece from there are at hand. What is held are the
    characters, scores and backpointers from the last committed boundary to the furthest end of a piece. The boundary moves on to a start that no piece goes beyond, as all
    paths lead through it, and, when WINDOWS times the longest piece is held, to where the backpointers of all ends that can still go on meet.
    """

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.unknown = min(pieces.score.values()) - UNKNOWN_PENALTY
        #: Scores of pieces, and False for what only starts one.
        self.table: dict = {x[:n]: False for x in pieces.score for n in range(1, len(x))} | pieces.score
        self.reset()

    def reset(self) -> None:
        self.held, self.at = "", 0  # characters since the boundary, and the next start among them
        self.best: list = [0.0]
        self.back = [0]
        self.widest = 0  # the most characters that were held

    def push(self, chars: str) -> list[int]:
        self.held += chars
        return self._advance(len(self.held) - self.p.longest + 1)

    def finish(self) -> list[int]:
        ids = self._advance(len(self.held))
        widest = self.widest
        self.reset()
        self.widest = widest
        return ids

    def encode(self, chars: str) -> list[int]:
        return self.push(chars) + self.finish()

    def _advance(self, stop: int) -> list[int]:
        """Take the starts before `stop`."""
        table, score, unknown, full = self.table, self.p.score, self.unknown, WINDOWS * self.p.longest
        s, best, back, a = self.held, self.best, self.back, self.at
        n, out = len(s), []
        while a < stop:
            before, reach = best[a], len(best) - 1
            for b in range(a + 1, n + 1):
                v = table.get(s[a:b])
                if v is None:  # no piece starts so
                    break
                if v is not False:
                    while reach < b:
                        best.append(None)
                        back.append(0)
                        reach += 1
                    v += before
                    if best[b] is None or v > best[b]:
                        best[b], back[b] = v, a
            if s[a] not in score:
                if reach == a:
                    best.append(None)
                    back.append(0)
                v = before + unknown
                if best[a + 1] is None or v > best[a + 1]:
                    best[a + 1], back[a + 1] = v, a
            a += 1
            if len(best) - 1 == a or a >= full:
                cut = a if len(best) - 1 == a else self._meeting(a)
                self.widest = max(self.widest, len(best) - 1)
                if cut:
                    out += self._path(s, back, cut)
                    base = best[cut]
                    s, best, back = s[cut:], [None if x is None else x - base for x in best[cut:]], [max(0, x - cut) for x in back[cut:]]
                    a, stop, n = a - cut, stop - cut, n - cut
                    self.best, self.back = best, back
        self.held, self.best, self.back, self.at = s, best, back, a
        return out

    def _meeting(self, a: int) -> int:
        """The boundary through which the paths of all ends from `a` on lead."""
        meet = {x for x in range(a, len(self.best)) if self.best[x] is not None}
        while len(meet) > 1:
            top = max(meet)
            meet.discard(top)
            meet.add(self.back[top])
        return meet.pop()

    def _path(self, s: str, back: list[int], n: int) -> list[int]:
        out: list[int] = []
        while n:
            piece = s[back[n] : n]
            known = self.p.id.get(piece)
            out[:0] = [known] if known is not None else [self.p.byte_id[x] for x in piece.encode()]
            n = back[n]
        return out


class Codec:
    """Encodes texts stretch by stretch, and decodes ids."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.search = StreamingViterbi(self.pieces)
        self.cache = WordCache(self._encode, 600_000)
        self.flat = np.frombuffer(b"".join(self.pieces.raw), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in self.pieces.raw])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _encode(self, stretch: str) -> bytes:
        ids = self.search.encode(marked(stretch))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = stretches(text or "")
        return b"".join([self.cache[x] if len(x) < LONG else self._encode(x) for x in parts])

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[places].tobytes().decode("utf-8", "replace").replace(MARK, " ")[1:]


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for each model in a Python worker, so that caches outlive tasks."""
    key = zlib.crc32(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each row's text as an array."""
    return _mapped(df, model, id_col, text_col, f"{id_col} long, ids array<int>", lambda c, text: (np.frombuffer(c.encode(text), dtype="<u4").astype(np.int32),), [pa.list_(pa.int32())], ["ids"])


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids)."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for batch in batches:
            texts = [c.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(F.col(id_col).cast("long").alias(id_col), "ids").mapInArrow(run, f"{id_col} long, text string")


def check_round_trip(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, round_trip): the ids' count and checksum, and whether decoding them gives the text that the model reads."""

    def one(c: Codec, text: str | None):
        held = c.encode(text)
        back = c.decode(np.frombuffer(held, dtype="<u4"))
        return len(held) // 4, zlib.crc32(held), back == (text or "").replace(MARK, " ")

    return _mapped(df, model, id_col, text_col, f"{id_col} long, n_ids long, ids_crc32 long, round_trip boolean", one, [pa.int64(), pa.int64(), pa.bool_()], ["n_ids", "ids_crc32", "round_trip"])


def _mapped(df: DataFrame, model: bytes, id_col: str, text_col: str, schema: str, one, types: list, names: list[str]) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for batch in batches:
            rows = [one(c, x.as_py()) for x in batch.column(1)]
            cols = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), t) for x, t in zip(cols, types, strict=True))], [id_col, *names])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t")).mapInArrow(run, schema)
