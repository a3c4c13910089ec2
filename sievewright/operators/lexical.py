"""BM25 over a stored inverted index, with dynamic pruning.

The index is made of blocks, up to BLOCK documents of one task and scope each, and built where the documents lie: nothing is moved. It
has a row for each term of a block: the documents' numbers in the block, ascending by id, and how often each has the term,
beside the number of postings, the highest count and the shortest length, from which an upper bound of the term's weight follows. A row with an
empty term holds the block's ids and lengths. A term that all documents have is thus spread over all blocks. A scope is
a set of documents with statistics of its own.

A search joins the asked terms with the index, so that only their rows are read, and brings the rows of a block together.
There each query's terms are summed up from the highest bound down. As soon as the bounds of what is left can't lift a
document without what has been summed into the block's k best, the rest is looked up only for documents that can still get there.
What leaves a block is k rows for each query. idf and average length are those of the whole scope, and enter at search
time, so that blocks can be added to a stored index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..sources.tables import stored

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

K1, B = 1.5, 0.75
DIGITS = 6
BLOCK = 4_096
#: How many words a block is made of at most, unless one document has more: what a task holds beside its Arrow batch grows with them.
WORDS = 500_000
#: How many bytes of text are cut into words at once, unless one document has more, and how many words that the index keeps wait for their blocks in a task, over all scopes.
BYTES, WAITING = 3_000_000, 2_000_000
#: How many terms are summed between two looks at the k-th best score.
LOOK = 8
#: Terms to which a one-search index is cut down at most; with more it holds all terms.
TERMS = 200_000
#: What rounding may add to a score.
SLACK = 1e-6


def build(docs: DataFrame, vocabulary: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The index of docs (scope, id, text), or (scope, id, words, length) where their words are cut down already, ids of any one type; rows with a null scope take no part. A task's documents wait until their scope fills a block; blocks are small where a task has very many scopes, so sort such docs by scope first. With a vocabulary (term) only of its terms. With a path it is stored there for good, else until the driver ends."""
    kind = docs.schema["id"].dataType
    wanted = None
    if vocabulary is not None:
        few = vocabulary.select("term").distinct().limit(TERMS + 1).collect()  # at most TERMS + 1 short strings
        wanted = {r.term for r in few} if len(few) <= TERMS else None
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms = None if held.value is None else pa.array(sorted(held.value), pa.string())
        waiting: dict[str, list] = {}  # of each scope: its parts, and how many documents, words and kept words they have

        def block(scope: str) -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting.pop(scope)[0])
            rows = rows.take(pc.sort_indices(rows.column("id"))).combine_chunks()
            return _block(scope, *(rows.column(c).chunk(0) for c in ("id", "words", "length")), np, pa)

        for whole in batches:
            whole = whole.filter(whole.column(0).is_valid())  # no query has a null scope
            size, most = (whole.column(2).value_lengths(), WORDS) if cut else (pc.binary_length(whole.column(2)), BYTES)
            for some in _parts(whole, size, most, np):
                coded = some.column(0).dictionary_encode()
                words, length = _kept(some.column(2) if cut else _words(some.column(2), np, pa), some.column(3), terms, np, pa, pc)
                told = pa.RecordBatch.from_arrays([some.column(1), words, length], ["id", "words", "length"])
                order = np.argsort(np.asarray(coded.indices), kind="stable")
                cuts = np.flatnonzero(np.diff(np.asarray(coded.indices)[order], prepend=-1)).tolist() + [len(order)]
                for scope, begin, end in zip(coded.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True):
                    rows = told.take(pa.array(order[begin:end]))
                    for part in (p.slice(a, BLOCK) for p in _parts(rows, rows.column(2), WORDS, np) for a in range(0, p.num_rows, BLOCK)):
                        more = part.num_rows, pc.sum(part.column(2)).as_py(), len(part.column(1).flatten())
                        if scope in waiting and (waiting[scope][1] + more[0] > BLOCK or waiting[scope][2] + more[1] > WORDS):
                            yield block(scope)
                        before = waiting.get(scope, ([], 0, 0, 0))
                        waiting[scope] = [before[0] + [part], *(a + b for a, b in zip(before[1:], more, strict=True))]
                while sum(w[3] for w in waiting.values()) > WAITING:
                    yield block(max(waiting, key=lambda s: waiting[s][3]))
        for scope in list(waiting):
            yield block(scope)

    schema = S.StructType(
        [S.StructField("scope", S.StringType()), S.StructField("block", S.LongType()), S.StructField("term", S.StringType()), S.StructField("n", S.IntegerType()), S.StructField("high", S.IntegerType()), S.StructField("short", S.IntegerType())]
        + [S.StructField(c, S.ArrayType(k)) for c, k in (("at", S.IntegerType()), ("tf", S.IntegerType()), ("ids", kind))]
    )
    cut = "words" in docs.columns
    rows = docs.select(F.col("scope").cast("string").alias("scope"), "id", F.col("words").alias("w") if cut else F.lower(T.text(F.col("text"))).alias("w"), F.col("length").cast("int").alias("n") if cut else F.lit(None).cast("int").alias("n"))
    return stored(rows.mapInArrow(run, schema), "lexical-index", path)


def _parts(batch, sizes, most: int, np) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose sizes add up to `most`, or of one row."""
    ends, at = np.cumsum(np.asarray(sizes.fill_null(0), dtype=np.int64)), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _words(texts, np, pa):
    """The tokens of lower-cased texts, as text.tokens() has them, in lists: what is none of its characters goes, and words begin where one of them follows another character or begins a text."""
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8))[data]
    before = np.r_[False, inside][:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    first = np.flatnonzero(inside & ~before)
    at = np.r_[np.cumsum(inside, dtype=np.int32)[first] - 1, np.int32(np.count_nonzero(inside))].astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends), pa.int32()), words)


def _kept(lists, longer, terms, np, pa, pc):
    """The words of each document that are among the terms, and how many it has; longer tells that where the lists are cut already."""
    held = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    words, length = lists.flatten(), pc.coalesce(longer, pa.array(held, pa.int32()))
    some = np.ones(len(words), dtype=bool) if terms is None else np.asarray(pc.is_in(words, value_set=terms))
    ends = np.r_[0, np.cumsum(some)][np.r_[0, np.cumsum(held)]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words if terms is None else words.filter(pa.array(some))), length


def _block(scope: str, ids, lists, lengths, np, pa):
    """A block's rows. lists: the kept words of each document; lengths: how many it has in all."""
    held = np.asarray(lists.value_lengths(), dtype=np.int64)
    doc, lengths = np.repeat(np.arange(len(ids)), held), np.asarray(lengths, dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    pair, tf = np.unique(np.asarray(coded.indices, dtype=np.int64) * max(1, len(ids)) + doc, return_counts=True)
    term, at = np.divmod(pair, max(1, len(ids)))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, dtype=np.int64)
    ends = np.r_[first, len(term)]
    high, short = (np.maximum.reduceat(tf, first), np.minimum.reduceat(lengths[at], first)) if len(first) else (first, first)
    m, longs = len(first), len(ids)
    ints = lambda x: pa.array(np.asarray(x), pa.int32())
    offsets = np.r_[ends if m else [0], (len(term) + longs)]
    cols = [
        pa.array([scope] * (m + 1), pa.string()), pa.array([uuid.uuid4().int >> 65] * (m + 1), pa.int64()), pa.concat_arrays([coded.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.array([""])]),
        ints(np.r_[np.diff(ends), longs] if m else [longs]), ints(np.r_[high, 0]), ints(np.r_[short, 0]),
        pa.ListArray.from_arrays(ints(offsets), ints(np.r_[at, np.arange(longs)])), pa.ListArray.from_arrays(ints(offsets), ints(np.r_[tf, lengths])),
        pa.ListArray.from_arrays(ints(np.r_[np.zeros(m + 1), longs]), ids),
    ]
    return pa.RecordBatch.from_arrays(cols, ["scope", "block", "term", "n", "high", "short", "at", "tf", "ids"])


def members(index: DataFrame) -> DataFrame:
    """(scope, id) of all documents of an index."""
    return index.filter("term = ''").select("scope", F.explode("ids").alias("id"))


def vocabulary(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()


def sizes(index: DataFrame) -> DataFrame:
    """(scope, docs, avgdl)"""
    every = index.filter("term = ''").select("scope", "n", F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x).alias("dl"))
    return every.groupBy("scope").agg(F.sum("n").alias("docs"), (F.sum("dl") / F.greatest(F.sum("n"), F.lit(1))).alias("avgdl"))


def weighted(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, scope, term, weight, avgdl): the asked terms that a scope has, weighted by idf and their number in the query."""
    asked = queries.select("query_id", F.col("scope").cast("string").alias("scope"), F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf"))
    df = index.filter("term <> ''").join(asked.select("scope", "term").distinct(), ["scope", "term"], "left_semi").groupBy("scope", "term").agg(F.sum("n").alias("df"))
    told = df.join(sizes(index), "scope")
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return asked.join(told.select("scope", "term", idf.alias("idf"), "avgdl"), ["scope", "term"]).select("query_id", "scope", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl")


def _scored(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, scope, block, id, score, listed, summed, looked_up): each block's k best documents of each query; the counts are the block's for the query, on its first row."""
    asked = stored(weighted(index, queries), "lexical-asked")
    by_term = asked.groupBy("scope", "term").agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("query_id", "weight")).alias("asks"))
    lists = index.filter("term <> ''").join(by_term, ["scope", "term"]).select("scope", "block", "term", "at", "tf", "high", "short", "avgdl", "asks")
    whole = index.filter("term = ''").join(asked.select("scope").distinct(), "scope", "left_semi").select(F.col("scope").alias("scope"), F.col("block").alias("block"), F.col("tf").alias("dl"), "ids")

    def run(rows: pa.Table, about: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        scope, block, ids = about.column("scope")[0].as_py(), about.column("block")[0].as_py(), about.column("ids")[0].values
        out = []
        if rows.num_rows:
            for query, *found in _best(rows, np.asarray(about.column("dl")[0].values, dtype=float), k):
                out += [(query, i, s, *(found[2:] if not n else (0, 0, 0))) for n, (i, s) in enumerate(zip(*found[:2], strict=True))]
        query, i, s, *counts = zip(*out, strict=True) if out else ([],) * 6
        cols = [pa.array(query, asks_kind), pa.array([scope] * len(out), pa.string()), pa.array([block] * len(out), pa.int64()), ids.take(pa.array(i, pa.int64())), pa.array(s, pa.float64()), *(pa.array(c, pa.int64()) for c in counts)]
        return pa.Table.from_arrays(cols, names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["query_id", "scope", "block", "id", "score", "listed", "summed", "looked_up"]
    kind = queries.schema["query_id"].dataType
    asks_kind = to_arrow_type(kind)
    fields = [("query_id", kind), ("scope", S.StringType()), ("block", S.LongType()), ("id", index.schema["ids"].dataType.elementType), ("score", S.DoubleType()), *((c, S.LongType()) for c in names[5:])]
    return lists.groupBy("scope", "block").cogroup(whole.groupBy("scope", "block")).applyInArrow(run, S.StructType([S.StructField(*f) for f in fields]))


def _best(rows, dl: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, numbers, scores, listed, summed, looked up) of a block's k best documents of each query that asks for one of the rows' terms."""
    import numpy as np

    avgdl = rows.column("avgdl")[0].as_py() or 1.0
    spread = K1 * (1 - B + B * dl / avgdl)
    lists, tfs, high, short, told = (rows.column(c).combine_chunks() for c in ("at", "tf", "high", "short", "asks"))
    flat, tf, high, short = np.asarray(lists.flatten()), np.asarray(tfs.flatten(), dtype=float), np.asarray(high, dtype=float), np.asarray(short, dtype=float)
    cuts = np.cumsum(np.asarray(lists.value_lengths()))[:-1]
    at, weight = np.split(flat, cuts), np.split(tf * (K1 + 1) / (tf + spread[flat]), cuts)
    bound = high * (K1 + 1) / (high + K1 * (1 - B + B * short / avgdl))
    asked, of = told.flatten(), np.repeat(np.arange(len(told)), np.asarray(told.value_lengths()))  # each ask, and its term's number
    names, own = asked.field("query_id").dictionary_encode(), np.asarray(asked.field("weight"), dtype=float)
    most, number = own * bound[of], np.asarray(names.indices)
    order = np.lexsort((-of, -most, number))
    parts = np.split(order, np.flatnonzero(np.diff(number[order])) + 1)
    for query, part in zip(names.dictionary.to_pylist(), parts, strict=True):
        left = np.r_[np.cumsum(most[part][::-1])[::-1], 0.0]  # bounds of a term and those after it
        score, some, n = np.zeros(len(dl)), None, 0
        summed = looked = 0
        terms = list(zip(of[part].tolist(), own[part].tolist(), strict=True))
        for n, (j, w) in enumerate(terms):
            if n and n % LOOK == 0 and len(dl) > k and some is None:
                least = np.partition(score, len(dl) - k)[len(dl) - k]
                if least > 0 and left[n] < least - SLACK:
                    some = score + left[n] >= least - SLACK
            if some is None:
                score[at[j]] += w * weight[j]
                summed += len(at[j])
            else:
                near = some[at[j]]
                score[at[j][near]] += w * weight[j][near]
                looked += int(near.sum())
        final = np.round(score, DIGITS)
        final = final if some is None else np.where(some, final, 0.0)
        found = np.flatnonzero(final > 0) if len(dl) <= k else np.flatnonzero((final > 0) & (final >= np.partition(final, len(dl) - k)[len(dl) - k]))
        found = found[np.lexsort((found, -final[found]))][:k]
        yield query, found.tolist(), final[found].tolist(), sum(len(at[j]) for j, _ in terms), summed, looked


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, scope, id, rank, score) of queries (query_id, scope, text): the k best documents of each query in its scope that share a term with it. Scores are rounded before ranking, and equal ones go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "id"))
    return _scored(index, queries, k).select("query_id", "scope", "id", "score").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "scope", "id", "rank", "score")


def reading(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, scope, postings, summed, looked_up, moved): how many postings the terms of a query have, how many of them a search sums up for all documents, how many it looks up for candidates, and how many rows leave the blocks."""
    rows = _scored(index, queries, k)
    return rows.groupBy("query_id", "scope").agg(F.sum("listed").alias("postings"), F.sum("summed").alias("summed"), F.sum("looked_up").alias("looked_up"), F.count("*").alias("moved"))
