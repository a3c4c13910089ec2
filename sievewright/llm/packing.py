"""Packing token sequences by minimum bin slack.

A document's ids are cut at every multiple of the capacity; the last piece of each is shorter. A histogram of piece
lengths, at most `capacity` counts whatever the corpus, goes to the driver. There each window starts with the longest
length left, and a bitset subset-sum program picks the multiset of remaining lengths that fills the rest of the window
closest to capacity; the lengths' counts are found by tracing the program back. The same filling is repeated as often
as the counts allow. Fillings become intervals of ranks within each length, and every piece looks its place up by rank.

Ranks are counted in buckets of about BUCKET pieces of one length, so that a length that many documents share is no
large group. Texts never move: a piece's row holds its checksum, and its ids on request.

Defined cases: null text counts as empty: one piece, of the end id alone; documents of any length are cut whole;
repeated rows are packed each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, staged
from .wordtable import splits_words

CAPACITY = 4096
END = 2
BUCKET = 2_000
#: Bytes of text that are encoded together, at least one text.
GROUP = 6 << 20
#: Plain words that are encoded in one call.
LINE = 200


LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Full stops and commas at a word's end are tokens of their own after these: small letters and digits, and the two-byte letters of Latin-1.
_POINTED = re.compile(rb"(?s).*(?:[a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf])[.,]")
#: Words of such letters alone need neither normaliser nor pre-tokenizer.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level tokenizers write bytes 0x9F, 0xA0 and 0xAD, of these letters, as other characters than Latin-1 does.
_BYTES = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))


#: Words that show whether a tokenizer lower-cases, and whether a last point or comma stands alone.
_CASES = [chr(c) + x for c in range(65, 91) for x in ("", "a", "B", "zz", "é", "9", "'S")]
_STEMS = ["a", "the", "tion" * 9, "x9", "9", "é", "déjà", "ÿ", "1a"]


class WordEncoder:
    """Ids of texts, word by word, of tokenizers that drop white space, so that no id spans two words; others are refused. Two generations of at most `most` words bound the cache. What is taken for granted to save time is probed first: lower-casing, points that stand alone, and plain words that need no normaliser."""

    def __init__(self, tokenizer: str, most: int = 350_000):
        from tokenizers import Tokenizer

        if not splits_words(tokenizer):
            raise ValueError("the tokenizer doesn't encode words one by one")
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.most, self.young, self.old = most, {}, {}
        self.lowers = self._full([x.encode() for x in _CASES]) == self._full([x.encode().translate(LOWERED) for x in _CASES])
        self.points = {p: self._full([p])[0] for p in (b".", b",")}
        alone = [[x.encode() + p for x in _STEMS] for p in self.points]
        stems = self._full([x.encode() for x in _STEMS])
        self.pointed = all(self._full(ws) == [i + self.points[p] for i in stems] for p, ws in zip(self.points, alone, strict=True))
        bare = json.loads(tokenizer) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        probe = [chr(c).encode() * k for c in (*range(97, 123), 0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)) for k in (1, 2, 3)] + [b"the", b"tion" * 9, "déjà".encode()]
        self.plain = self._bare(probe) == self._full(probe)

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text, with A-Z lower-cased if the tokenizer does so, so that there are fewer different ones; not where marks that combine or special strings may stand, for which that would not be the same."""
        if not self.lowers or b"\xcc" in text or b"\xcd" in text or b"<|" in text:
            return text.split()
        return text.translate(LOWERED).split()

    def _full(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([w.decode() for w in parts], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _bare(self, parts: list[bytes]) -> list[bytes]:
        """Ids of plain words, by the tokenizer's merges alone, a line of words at a time."""
        out: list[bytes] = []
        for at in range(0, len(parts), LINE):
            line = b" ".join(parts[at : at + LINE]).decode("latin-1")
            for a, b in _BYTES:
                line = line.replace(a, b)
            made = self.bare.encode(line, add_special_tokens=False)
            raw = array("I", made.ids).tobytes()
            ends = (4 * np.cumsum(np.bincount(made.word_ids, minlength=len(parts[at : at + LINE])))).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _made(self, parts: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in parts if _PLAIN.fullmatch(w)] if self.plain else []
        known = dict(zip(plain, self._bare(plain), strict=True))
        other = [w for w in parts if w not in known]
        return known | dict(zip(other, self._full(other), strict=True))

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. A word with a last point is the word without it, which may be known, and the point."""
        stems = {w: w[:-1] for w in new if _POINTED.fullmatch(w)} if self.pointed else {}
        ask = {x for x in (stems.get(w, w) for w in new) if x not in self.young and x not in self.old}
        made = self._made(list(ask))
        for w, stem in stems.items():
            found = made.get(stem) or self.young.get(stem) or self.old[stem]
            made[w] = found + self.points[w[-1:]]
        return made

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of UTF-8 texts."""
        split = [self.words(t) for t in texts]
        known, new, young, old = {}, [], self.young, self.old
        for w in set().union(*split):
            found = young.get(w)
            if found is None:
                found = old.get(w)
                if found is None:
                    new.append(w)
                    continue
                young[w] = found
            known[w] = found
        if new:
            made = self._learn(new)
            known.update(made)
            young.update(made)
        if len(young) > self.most:
            self.old, self.young = young, {}
        return [b"".join(map(known.__getitem__, ws)) for ws in split]


_encoders: dict[int, WordEncoder] = {}


def encoder(tokenizer: str) -> WordEncoder:
    """One encoder for each tokenizer in a Python worker, so that its cache outlives tasks."""
    key = zlib.crc32(tokenizer.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer)
    return _encoders[key]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of a batch, GROUP bytes at a time."""
    docs, texts, size = [], [], 0
    for doc, x in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
        docs.append(doc.as_py())
        texts.append(x.as_py() or b"")
        size += len(texts[-1])
        if size >= GROUP:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): a row for each piece."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(tokenizer)
    last = np.array([end_id], dtype="<u4").tobytes()

    def rows_of(docs: list, ids_of: list[bytes]) -> pa.RecordBatch:
        rows = []
        for doc, ids in zip(docs, ids_of, strict=True):
            ids += last
            n = len(ids) // 4
            for a in range(0, n, capacity):
                cut = ids[4 * a : 4 * (a + capacity)]
                rows.append((doc, a, len(cut) // 4, zlib.crc32(cut), n, np.frombuffer(cut, dtype="<u4").astype(np.int32) if keep_ids else None))
        cols = list(zip(*rows, strict=True))
        out = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if keep_ids else [])
        return pa.RecordBatch.from_arrays(out, [id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = encoder(held.value)
        collects = gc.isenabled()
        gc.disable()  # millions of small objects, none of them in a cycle
        try:
            for batch in batches:
                for docs, texts in _groups(batch):
                    yield rows_of(docs, made.encode(texts))
        finally:
            if collects:
                gc.enable()

    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t")).mapInArrow(run, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to room without passing it."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    goal = 1 << room
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies at a time reach every count
            take = min(unit, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            unit *= 2
        if bits & goal:
            break
    total = bits.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fill(left, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        out.append((used, times))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def places(fillings: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks within each length, sorted by length and first rank: copies per sequence, first sequence, first offset."""
    rows, seen, sequence = [], {}, 0
    for used, times in fillings:
        offset = 0
        for x in sorted(used, reverse=True):
            rows.append((x, seen.get(x, 0), used[x], sequence, offset))
            seen[x] = seen.get(x, 0) + used[x] * times
            offset += x * used[x]
        sequence += times
    rows.sort()
    names = ("length", "first", "copies", "sequence", "offset")
    return {k: np.array(v, dtype=np.int64) for k, v in zip(names, zip(*rows, strict=True), strict=True)} if rows else {k: np.empty(0, dtype=np.int64) for k in names}


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset): a row for each piece."""
    spark = df.sparkSession
    cut = staged(pieces(df, tokenizer, capacity, end_id, keep_ids, id_col, text_col), "pack-pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    at = places(plan(counts, capacity))
    held = spark.sparkContext.broadcast(at)

    share = F.lit([max(1, math.ceil(counts.get(x, 0) / BUCKET)) for x in range(capacity + 1)])
    bucket = F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.element_at(share, (F.col("length") + 1).cast("int")))
    ranked = cut.withColumn("__b", bucket).withColumn("__r", F.expr(f"row_number() OVER (PARTITION BY length, __b ORDER BY {id_col}, start, ids_crc32) - 1"))
    sizes = cut.withColumn("__b", bucket).groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.expr("sum(__n) OVER (PARTITION BY length ORDER BY __b) - __n")).select("length", "__b", "__before")
    rows = ranked.join(before, ["length", "__b"]).withColumn("__rank", F.col("__before") + F.col("__r")).select(*cut.columns, "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        step = np.int64(2) ** 44
        keys = t["length"] * step + t["first"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "__rank"))
            k = np.searchsorted(keys, length * step + rank, side="right") - 1
            own = rank - t["first"][k]
            sequence, offset = t["sequence"][k] + own // t["copies"][k], t["offset"][k] + own % t["copies"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    return rows.mapInArrow(place, schema)
