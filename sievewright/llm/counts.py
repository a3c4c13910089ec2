"""Token counts by prefix dynamic programming over BPE pieces.

The encoding of a prefix ends in the one piece that is compatible with the last piece of the encoding of what precedes
it, where two pieces are compatible if BPE leaves them as they are when they stand side by side. So
count(i) = count(i - length of that piece) + 1 gives the exact count at every prefix in one pass, and questions about
truncation or budgets are looked up. Unknown characters become bytes, which no merge crosses.

Tables are made once for each stretch between spaces (pieces.py); their last counts are kept in a bounded cache, and the
tables themselves are made again where a text is cut. Merges of runs of spaces have equal scores, for which compatibility
of neighbours isn't enough; tables of stretches with spaces are checked against the library, and should one differ it is
made anew by encoding every prefix with the library.

Defined cases: null text counts as empty: 0 bytes, 0 tokens; texts of any length; repeated rows count alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, ship
from .pieces import LONG, Pieces, marked, stretches

LIMIT = 4096


class PrefixCounts:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.fits: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.totals = WordCache(lambda x: self._table(x)[-1], 400_000)
        self.tables = WordCache(self._table, 30_000)

    def bpe(self, s: str) -> list[str]:
        """BPE of known characters: merge the pair of the best score, the leftmost of equals, until none is left."""
        parts, score = list(s), self.pieces.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, t: str) -> bool:
        found = self.alone.get(t)
        if found is None:
            found = self.alone[t] = len(self.bpe(t)) == 1
        return found

    def _compatible(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            found = self.fits[a, b] = self.bpe(a + b) == [a, b]
        return found

    def prefixes(self, s: str) -> list[int]:
        """Counts at the prefixes of 0 to len(s) characters of a marked stretch."""
        score, longest, fits = self.pieces.score, self.pieces.longest, self.fits
        counts, last = [0], [""]
        for end in range(1, len(s) + 1):
            for start in range(max(0, end - longest), end):
                t = s[start:end]
                if t in score:
                    before = last[start]
                    good = self._stands(t) if not before else fits.get((before, t))
                    if good is None:
                        good = self._compatible(before, t)
                    if good:
                        counts.append(counts[start] + 1)
                        last.append(t)
                        break
            else:
                counts.append(counts[-1] + (len(s[end - 1].encode()) if s[end - 1] not in score else 1))
                last.append("")
        return counts

    def _table(self, stretch: str) -> tuple[int, ...]:
        """Counts at every prefix of a stretch, its mark included."""
        s = marked(stretch)
        counts = self.prefixes(s)
        if " " in stretch and counts[-1] != len(self.pieces.library.encode(stretch)):
            counts = [0, *(len(self.pieces.library.encode(stretch[:i])) or 1 for i in range(len(stretch) + 1))]
        return tuple(counts)

    def table(self, stretch: str) -> tuple[int, ...]:
        return self.tables[stretch] if len(stretch) < LONG else self._table(stretch)

    def each(self, parts: list[str]) -> list[int]:
        """The counts of whole stretches."""
        totals = self.totals
        return [totals[x] if len(x) < LONG else self._table(x)[-1] for x in parts]

    def count(self, text: str) -> int:
        return sum(self.each(stretches(text)))

    def all_prefixes(self, text: str) -> list[int]:
        """Counts at the prefixes of 0 to len(text) characters."""
        out, base = [0], 0
        for k, x in enumerate(stretches(text)):
            t = self.table(x)
            # the mark before the first stretch is the model's, not a character of the text
            out.extend(base + c for c in t[2 if not k else 1 :])
            base += t[-1]
        return out

    def cut(self, text: str, limit: int) -> int:
        """The most characters of the text whose prefix has at most limit tokens."""
        parts = stretches(text)
        totals = list(accumulate(self.each(parts), initial=0))
        if totals[-1] <= limit:
            return len(text)
        chars = 0
        for k, x in enumerate(parts):
            if totals[k + 1] > limit:
                t = self.table(x)
                best = max((i for i in range(1, len(t)) if totals[k] + t[i] <= limit), default=0)
                return chars + best - (1 if not k and best else 0) if best else chars
            chars += len(x) + (1 if k else 0)
        return len(text)


_counters: dict[int, PrefixCounts] = {}


def counter(model: bytes) -> PrefixCounts:
    """One counter for each model in a Python worker, so that tables outlive tasks."""
    key = zlib.crc32(model)
    if key not in _counters:
        _counters[key] = PrefixCounts(model)
    return _counters[key]


def count_tokens(df: DataFrame, model: bytes, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, cut_chars): cut_chars is the most characters whose prefix keeps within the limit."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(held.value)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                n = c.count(text)
                rows.append((len(text.encode()), n, n > limit, c.cut(text, limit) if n > limit else len(text)))
            cols = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())], [id_col, "n_bytes", "n_tokens", "over_limit", "cut_chars"]
            )

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t")).mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_counts(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): the count at every prefix, from 0 characters to all."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.all_prefixes(x.as_py() or "") for x in part.column(1)], pa.list_(pa.int32()))], [id_col, "counts"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t")).mapInArrow(run, f"{id_col} long, counts array<int>")
