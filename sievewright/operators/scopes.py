"""Objectives like the one that is asked: a search by set similarity of their tokens, and the scopes that a search looks into."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

# Fixed values.
STOPWORDS = (
    "a", "an", "and", "architecture", "architectures", "based", "compare", "different", "for", "from", "how", "in", "is", "of", "on", "research", "the", "to", "what", "with",
)
ALIASES = {"indian": "india", "cultures": "culture", "cultural": "culture", "transformers": "transformer"}
SIMILAR, MOST = 0.40, 6
#: Sets and scopes that meet in one task at most (on average), and how many tasks there are at most.
ASKED, HELD, TASKS = 8_192, 65_536, 2_000
CURRENT, OTHER = "current_objective", "similar_previous_objective"


def objective_tokens(c: Column) -> Column:
    """The different words of an objective in one form, without stopwords and words under three letters."""

    def form(t: Column) -> Column:
        n = F.length(t)
        plain = F.when(F.endswith(t, F.lit("ies")) & (n > 4), F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y"))).when(F.endswith(t, F.lit("s")) & (n > 4), F.substr(t, F.lit(1), n - 1)).otherwise(t)
        for word, alias in ALIASES.items():
            plain = F.when(t == word, alias).otherwise(plain)
        return plain

    return F.array_distinct(F.filter(F.transform(T.tokens(c), form), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))


def _first(df: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first rows of each `by` from which, whatever history_key is left out, `most` others can be taken: at most `most` of a key and twice as many in all."""
    for keys, n in (([*by, "history_key"], most), (by, 2 * most)):
        df = df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("r") <= n).drop("r")
    return df


def similar(asked: DataFrame, scopes: DataFrame, least: float = SIMILAR, most: int = MOST) -> DataFrame:
    """(set, similarity, lower, history_key, objective): for each asked set (set, t) the first scopes (set, t, lower, history_key, objective) that are like it, as many as _first() keeps. Similarity is
    the larger of Jaccard's and the overlap coefficient, at least `least`; the most similar come first, then the smaller lower and history_key.

    The overlap coefficient is the larger one always, and sets of ten words share one with most others, so pairs are never rows: both sides are dealt to parts of bounded size, each part of
    scopes meets each part of what is asked in one task, and only the first scopes of each asked set leave it.
    """
    asked, scopes = tables.stored(asked.select("set", "t"), "scopes-asked"), tables.stored(scopes.select("set", "t", "lower", "history_key", "objective"), "scopes-held")
    n_asked, n_held = -(-asked.count() // ASKED) or 1, -(-scopes.count() // HELD) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(TASKS, 2 * n_asked * n_held)
    mine = asked.withColumn("a", F.pmod(F.xxhash64("set"), F.lit(n_asked)).cast("int")).withColumn("b", every(n_held)).repartition(tasks, "a", "b")
    theirs = scopes.withColumn("b", F.pmod(F.xxhash64("set", "history_key", "objective"), F.lit(n_held)).cast("int")).withColumn("a", every(n_asked)).repartition(tasks, "a", "b")

    def nearest(asked: pa.ChunkedArray, held: pa.ChunkedArray, keys: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number, rows of held, similarities) for each of the asked sets: the first of held, of which earlier rows come first where equal, as in _first()."""
        import numpy as np
        import pyarrow.compute as pc

        asked, held = asked.combine_chunks(), held.combine_chunks()
        sizes = lambda x: np.asarray(pc.list_value_length(x), dtype=np.int64)
        coded = held.flatten().dictionary_encode()
        size, asked_size = sizes(held), sizes(asked)
        words = np.asarray(coded.indices, dtype=np.int64)
        order = np.argsort(words, kind="stable")
        row = np.repeat(np.arange(len(size)), size)[order]
        begin = np.searchsorted(words[order], np.arange(len(coded.dictionary) + 1))
        terms = np.asarray(pc.fill_null(pc.index_in(asked.flatten(), value_set=coded.dictionary), -1), dtype=np.int64)
        ends = np.cumsum(asked_size)
        key = np.asarray(keys.combine_chunks().dictionary_encode().indices, dtype=np.int64)
        for i, (n, end) in enumerate(zip(asked_size.tolist(), ends.tolist(), strict=True)):
            lists = [row[begin[t] : begin[t + 1]] for t in terms[end - n : end] if t >= 0]
            if not lists:
                continue
            met, shared = np.unique(np.concatenate(lists), return_counts=True)
            score = shared / np.minimum(size[met], n)
            like = score >= least
            met, score = met[like], score[like]
            take = 2 * most
            while True:  # one key may have more than `most` of the first rows
                if len(met) > take:
                    limit = np.partition(score, len(score) - take)[len(score) - take]
                    above = np.flatnonzero(score > limit)
                    some = np.concatenate([above, np.flatnonzero(score == limit)[: take - len(above)]])
                else:
                    some = np.arange(len(met))
                some = some[np.lexsort((some, -score[some]))]
                told: dict[int, int] = {}
                kept = []
                for x, k in zip(some.tolist(), key[met[some]].tolist(), strict=True):
                    told[k] = told.get(k, 0) + 1
                    if told[k] <= most:
                        kept.append(x)
                if len(kept) >= 2 * most or take >= len(met):
                    break
                take *= 4
            kept = np.asarray(kept[: 2 * most], dtype=np.int64)
            yield i, met[kept], score[kept]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        right = right.sort_by([("lower", "ascending"), ("history_key", "ascending"), ("objective", "ascending")])
        which, which_sim, rows = [], [], []
        if left.num_rows and right.num_rows:
            for i, at, found in nearest(left.column("t"), right.column("t"), right.column("history_key")):
                which.append(np.full(len(at), i))
                rows.append(at)
                which_sim.append(found)
        flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.empty(0, kind))
        at = flat(rows, "int64")
        cols = [left.column("set").take(flat(which, "int64")), flat(which_sim, "float64"), *(right.column(c).take(at) for c in ("lower", "history_key", "objective"))]
        return pa.Table.from_arrays(cols, ["set", "similarity", "lower", "history_key", "objective"])

    near = mine.groupBy("a", "b").cogroup(theirs.groupBy("a", "b")).applyInArrow(run, "set string, similarity double, lower string, history_key string, objective string")
    return _first(near, ["set"], [F.desc("similarity"), "lower", "history_key", "objective"], most)


def history_scopes(asked: DataFrame, stored: DataFrame, least: float = SIMILAR, most: int = MOST) -> DataFrame:
    """(id, place, history_key, objective, similarity, reason): the scopes that each asked objective (id, history_key, objective) looks into: its own first, then the stored
    ones (history_key, objective) that are like it, the most similar first, by name where equal, `most` in all. Stored pairs that differ in the objective's case only count
    once; blank keys and objectives take no part. Objectives with the same tokens are compared once."""
    clean = lambda df: df.withColumn("history_key", T.clean(F.col("history_key"))).withColumn("objective", T.clean(F.col("objective")))
    asked = clean(asked.select("id", "history_key", "objective"))
    pair = Window.partitionBy("history_key", F.lower("objective")).orderBy("objective")
    held = clean(stored.select("history_key", "objective")).filter("history_key <> '' AND objective <> ''").withColumn("r", F.row_number().over(pair)).filter("r = 1").drop("r")
    told = lambda df: df.withColumn("t", F.array_sort(objective_tokens(F.col("objective")))).withColumn("set", F.sha2(F.array_join("t", " "), 256))
    most = max(1, most)
    mine = tables.stored(told(asked), "scopes-own")
    theirs = told(held).filter(F.size("t") > 0).withColumn("lower", F.lower("objective"))
    # scopes with one set are equally similar to any, so a few of them are enough
    theirs = _first(theirs, ["set"], ["lower", "history_key", "objective"], most)
    sets = mine.filter(F.size("t") > 0).groupBy("set").agg(F.first("t").alias("t"))
    near = similar(sets, theirs, least, most)
    found = mine.select("id", F.col("history_key").alias("own"), "set").join(near, "set").filter("history_key <> own")
    rows = found.select("id", "history_key", "objective", "similarity", F.lit(OTHER).alias("reason"))
    rows = rows.unionByName(asked.filter("history_key <> ''").select("id", "history_key", "objective", F.lit(1.0).alias("similarity"), F.lit(CURRENT).alias("reason")))
    order = Window.partitionBy("id").orderBy(F.when(F.col("reason") == CURRENT, 0).otherwise(1), F.desc("similarity"), F.lower("objective"), "history_key")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("id", "place", "history_key", "objective", "similarity", "reason")
