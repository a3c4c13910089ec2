"""Exact top-k search by inner product: three-phase uniform threshold over local score lists.

A vector's components are cut into NODES runs; node j holds, for each query, the list of partial scores over run j.
Phase 1 gathers the k best entries of every local list. The full scores of these few candidates give a safe cutoff, which
k candidates are known to reach.
Phase 2 broadcasts the cutoff. Every list gives up its entries at or above the uniform threshold, cutoff / NODES; what it
keeps back is below the threshold, by which a candidate's full score is bounded from above: the entries given up, and the
largest integer below the threshold for each one kept back. A candidate that no list gives up has a full score below the
cutoff, and one whose bound is below the cutoff can't be among the k best.
Phase 3 resolves the full scores of the candidates that are left, exactly, and ranks them. No other full score is made.

Queries are taken in slabs of at most about SLAB, each of which is broadcast; candidates are read once for each slab
and pass (phases 2 and 3 share one, as a task holds all lists of its candidates), in blocks of Arrow batches, and never
moved. What moves is k rows for each query and partition.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows with null id, take no
part; a query's candidates are the other ids' vectors of its own length; several rows of one id are candidates each,
and give one row for each of them; equal scores go to the smaller id; fewer than k candidates are all returned;
components whose SCALE-fold isn't a finite double count as non-finite; sums are exact, and scores beyond 64 bits count as
the nearest long, so that such rank by id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, staged, vectors_of

K = 10
SCALE = 1024
NODES = 4
SLAB = 16_384
ROWS = 2_048
#: Pairs resolved, and entries held, at a time.
PAIRS, HELD = 65_536, 1_000_000
LONGEST = 2**63 - 1


def _scaled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def partial_scores(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Partial inner products (queries x candidates) over NODES runs of components, exact."""
    cuts = np.linspace(0, q.shape[1], NODES + 1).astype(int)
    q, c = _summable(q, c)
    return [q[:, a:b].dot(c[:, a:b].T) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_integers = np.frompyfunc(int, 1, 1)


def _summable(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same whole numbers in the first type that holds their inner products exactly: doubles, longs, or Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return q, c
    return (q.astype(np.int64), c.astype(np.int64)) if most < 2.0**62 else (_integers(q), _integers(c))


def _tiles(q: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of q and c to be scored together: small vectors all at once, those whose sums doubles can't hold in tiles, as longs and Python's integers take more room."""
    small = [np.abs(x).max(axis=1, initial=0) < 2.0 ** (26 - math.log2(max(1, x.shape[1])) / 2) for x in (q, c)]
    for a in (True, False):
        for b in (True, False):
            rows, cols = np.flatnonzero(small[0] == a), np.flatnonzero(small[1] == b)
            step = len(rows) if a and b else max(1, PAIRS // max(1, len(cols)))
            for at in range(0, len(rows) if len(cols) else 0, max(1, step)):
                yield rows[at : at + step], cols


def resolved(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Full scores of the pairs (rows[i], cols[i]); those beyond a long count as the nearest one."""
    out = np.empty(len(rows), dtype=np.int64)
    q, c = _summable(q, c)
    for at in range(0, len(rows), PAIRS):
        x, y = q[rows[at : at + PAIRS]], c[cols[at : at + PAIRS]]
        sums = (x * y).sum(axis=1)
        out[at : at + PAIRS] = np.clip(sums, -LONGEST, LONGEST).astype(np.int64) if q.dtype == object else sums.astype(np.int64)
    return out


def candidates(nodes: list[np.ndarray], cut: np.ndarray) -> np.ndarray:
    """Phase 2: which pairs may reach the cutoff of their query, by the entries that the lists give up."""
    least = -(-cut // NODES)[:, None]  # the uniform threshold, rounded up
    if nodes[0].dtype != float:
        least = least.astype(object)  # bounds may pass a long where partial scores are near it
    bound = np.zeros(nodes[0].shape, dtype=float if nodes[0].dtype == float else object)
    some = np.zeros(nodes[0].shape, dtype=bool)
    for scores in nodes:
        given = scores >= least
        some |= given
        bound += np.where(given, scores, least - 1)
    return some & (bound >= cut[:, None])


def _of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole numbers) for each length of vector in a batch of (id, vector)."""
    batch = batch.filter(batch.column(0).is_valid())
    ids = np.asarray(batch.column(0), dtype=np.int64)
    for rows, x in vectors_of(batch.column(1), _scaled):
        yield ids[rows], x


def _blocks(batches: Iterator[pa.RecordBatch], sets: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, queries, ids, candidates) to be scored together."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for ids, c in _of(batch.slice(at, ROWS)):
                for qids, q in sets:
                    if q.shape[1] == c.shape[1]:
                        for rows, cols in _tiles(q, c):
                            yield qids[rows], q[rows], ids[cols], c[cols]


class Best:
    """The k best entries (query, id, score) of each query; equal scores by smaller id."""

    def __init__(self, k: int):
        self.k, self.n, self.held = k, 0, [np.empty((0, 3), dtype=np.int64)]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.held.append(np.stack([query, ids, scores], axis=1))
        self.n += len(ids)
        if self.n > HELD:
            self.n = 0
            self.held = [self.cut()]

    def cut(self) -> np.ndarray:
        x = np.concatenate(self.held)
        x = x[np.lexsort((x[:, 1], -x[:, 2], x[:, 0]))]
        first = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]]) if len(x) else np.empty(0, dtype=np.int64)
        place = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        return x[place < self.k]

    def out(self) -> Iterator[pa.RecordBatch]:
        x = self.cut()
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x[:, j]) for j in range(3)], ["query_id", "vec_id", "score"])


def search(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates of df. queries: rows of df's form."""
    spark = df.sparkSession
    ship(spark)
    wanted = staged(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL"), "topk-queries")
    slabs = max(1, math.ceil(wanted.count() / SLAB))
    corpus = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    parts = [_slab(corpus, wanted.filter(F.pmod(F.xxhash64("id"), F.lit(slabs)) == s), k) for s in range(slabs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _slab(corpus: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    spark = corpus.sparkSession
    table = wanted.toArrow()  # about SLAB rows
    sets = [x for b in table.combine_chunks().to_batches() for x in _of(b)]
    held = spark.sparkContext.broadcast(sets)
    schema = "query_id long, vec_id long, score long"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for qids, q, ids, c in _blocks(batches, held.value):
            pick = np.zeros((len(qids), len(ids)), dtype=bool)
            for scores in partial_scores(q, c):  # the k best entries of each local list; one may be the query's own
                near = np.argpartition(-scores, k, axis=1)[:, : k + 1] if len(ids) > k + 1 else np.arange(len(ids))[None, :]
                np.put_along_axis(pick, np.broadcast_to(near, (len(qids), near.shape[1])), True, axis=1)
            rows, cols = np.nonzero(pick & (ids[None, :] != qids[:, None]))
            best.add(qids[rows], ids[cols], resolved(q, c, rows, cols))
        yield from best.out()

    gathered = corpus.mapInArrow(first, schema)
    by = "PARTITION BY query_id ORDER BY score DESC, vec_id"
    ranked = gathered.withColumn("r", F.expr(f"row_number() OVER ({by})")).filter(F.col("r") <= k)
    low = ranked.groupBy("query_id").agg(F.min("score").alias("cut"), F.count("*").alias("n")).filter(F.col("n") >= k)
    cuts = {r.query_id: r.cut for r in low.collect()}  # at most one row for each query of the slab
    told = spark.sparkContext.broadcast(cuts)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for qids, q, ids, c in _blocks(batches, held.value):
            nodes, cut = partial_scores(q, c), [told.value.get(int(qid)) for qid in qids]
            free = np.array([x is None for x in cut])  # queries with fewer than k candidates, all of which are resolved
            left = candidates(nodes, np.array([x or 0 for x in cut], dtype=np.int64)) | free[:, None]
            rows, cols = np.nonzero(left & (ids[None, :] != qids[:, None]))
            best.add(qids[rows], ids[cols], resolved(q, c, rows, cols))
        yield from best.out()

    final = corpus.mapInArrow(second, schema)
    return final.withColumn("rank", F.expr(f"row_number() OVER ({by})")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
