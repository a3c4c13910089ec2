"""Retrieval: BM25, vectors, fusion, diversification, expansion, evaluation. All queries are rows of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical

SEMANTIC, BM25, AUTHORITY, FEATURE = 0.55, 0.35, 0.10, 0.15
DIGITS = 6


def _top(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, rank, score). docs: (doc_id, text), queries: (query_id, text). An index of the queries' terms alone, for one search; lexical.build() makes one that is kept."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.lit("").alias("scope"), "text")
    index = lexical.build(docs.select(F.lit("").alias("scope"), F.col(doc_id).alias("id"), "text"), lexical.vocabulary(asked))
    return lexical.search(index, asked, k).select(F.col("query_id").alias(query_id), F.col("id").alias(doc_id), "rank", "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id[, scope], id, rank, score) by cosine. vectors: (id, v), queries: (query_id, v), either both with a scope or neither; a query sees its scope's vectors alone.

    Queries may be any number: slabs of at most about QUERIES travel to the vectors, which stay where they are and are read once for each slab. Matrix products over Arrow batches; what moves is k rows for each query and batch. Vectors of another length than the query's, null or with null or non-finite components, and null ids take no part.
    """
    scoped = "scope" in queries.columns
    if not scoped:
        vectors, queries = vectors.withColumn("scope", F.lit("")), queries.withColumn("scope", F.lit(""))
    wanted = queries.select("query_id", "scope", "v").filter("v IS NOT NULL AND size(v) > 0")
    slabs = max(1, -(-wanted.count() // QUERIES))
    out = None
    for slab in range(slabs):
        rows = wanted.filter(F.pmod(F.xxhash64("query_id", "scope"), F.lit(slabs)) == slab).collect()  # about QUERIES rows
        part = _nearest(vectors, rows, queries.schema["query_id"].dataType, k)
        out = part if out is None else out.unionByName(part)
    return out if scoped else out.drop("scope")


QUERIES = 4_000


def _nearest(vectors: DataFrame, rows: list, kind, k: int) -> DataFrame:
    import numpy as np
    from pyspark.sql import types as S
    from pyspark.sql.pandas.types import to_arrow_type

    groups: dict[tuple[str, int], list] = {}
    for r in rows:
        groups.setdefault((r.scope, len(r.v)), []).append(r)
    asked = {}
    for key, held in groups.items():
        m = np.array([[np.nan if x is None else x for x in r.v] for r in held], dtype=float)
        asked[key] = ([r.query_id for r in held], m / np.sqrt((m * m).sum(axis=1, keepdims=True)))
    told = vectors.sparkSession.sparkContext.broadcast(asked)
    asked_kind = to_arrow_type(kind)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2).cast(pa.list_(pa.float64()))
            sizes, flat = np.asarray(lists.value_lengths().fill_null(0)), np.asarray(lists.flatten().fill_null(float("nan")))
            ends, scopes, frames = np.cumsum(sizes), np.array(batch.column(1).to_pylist(), dtype=object), []
            ids = batch.column(0)
            place = np.empty(len(ids), dtype=np.int64)  # of ids in their order, for ties
            place[np.argsort(np.array(ids.to_pylist()), kind="stable")] = np.arange(len(ids))
            for (scope, n), (names, q) in told.value.items():
                at = np.flatnonzero((sizes == n) & (scopes == scope))
                if not len(at):
                    continue
                m = flat[(ends[at] - n)[:, None] + np.arange(n)]
                scores = np.round(q @ (m / np.sqrt((m * m).sum(axis=1, keepdims=True))).T, DIGITS)
                scores = np.where(np.isfinite(scores), scores, -9.0)
                low = np.partition(scores, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(names), -8.0)
                i, j = np.nonzero((scores >= low[:, None]) & (scores > -8.0))
                order = np.lexsort((place[at[j]], -scores[i, j], i))
                i, j = i[order], j[order]
                first = np.searchsorted(i, i)
                best = np.arange(len(i)) - first < k
                frames.append(pa.table({"query_id": pa.array([names[x] for x in i[best]], asked_kind), "scope": pa.array([scope] * int(best.sum()), pa.string()), "id": ids.take(pa.array(at[j[best]])), "score": pa.array(scores[i[best], j[best]])}))
            for f in frames:
                yield from f.to_batches()

    schema = S.StructType([S.StructField("query_id", kind), S.StructField("scope", S.StringType()), S.StructField("id", vectors.schema["id"].dataType), S.StructField("score", S.DoubleType())])
    found = vectors.select("id", "scope", "v").filter("id IS NOT NULL").mapInArrow(run, schema)
    return _top(found, ["query_id", "scope"], "score", "id", k).select("query_id", "scope", "id", "rank", "score")


def minmax(df: DataFrame, by: str | list[str], score: str, out: str) -> DataFrame:
    """Scores scaled to 0..1 within a group; a group without a positive score is 0, one whose scores are equal is 1."""
    w = Window.partitionBy(by) if isinstance(by, str) else Window.partitionBy(*by)
    high, low = F.max(score).over(w), F.min(score).over(w)
    scaled = F.when(high <= 0, 0.0).when(high == low, F.when(F.col(score) > 0, 1.0).otherwise(0.0)).otherwise((F.col(score) - low) / (high - low))
    return df.withColumn(out, scaled)


def phrase_overlap(query: Column, document: Column) -> Column:
    """The share of the query's phrases of two to four words, longer than five characters, that the document holds."""
    none = F.array().cast("array<string>")

    def phrases(words: Column, size: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(F.size(words) >= size, made).otherwise(none)

    def share(every: Column, lower: Column) -> Column:
        return F.when(F.size(every) == 0, 0.0).otherwise(F.size(F.filter(every, lambda p: F.contains(lower, p))) / F.size(every))

    def of(words: Column) -> Column:
        every = F.filter(F.concat(phrases(words, 2), phrases(words, 3), phrases(words, 4)), lambda p: F.length(p) > 5)
        return T.bind(every, lambda e: T.bind(F.lower(T.clean(document)), lambda d: share(e, d)))

    return T.bind(F.filter(T.tokens(query), lambda t: ~t.isin(*T.RETRIEVAL_STOPWORDS)), of)


def term_overlap(a: Column, b: Column) -> Column:
    """Shared relevance terms over the smaller set."""

    def of(s: Column) -> Column:
        return F.when((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0), 0.0).otherwise(F.size(F.array_intersect(s["x"], s["y"])) / F.least(F.size(s["x"]), F.size(s["y"])))

    return T.bind(F.struct(T.relevance_terms(a).alias("x"), T.relevance_terms(b).alias("y")), of)


def feature_score(query: Column, document: Column) -> Column:
    """How much of a query's terms and phrases a document holds; 0 where one of them has no terms."""

    def of(s: Column) -> Column:
        overlap = F.size(F.array_intersect(s["x"], s["y"])) / F.least(F.size(s["x"]), F.size(s["y"]))
        return F.when((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0), 0.0).otherwise(F.least(F.lit(1.0), 0.75 * overlap + 0.25 * phrase_overlap(query, document)))

    return T.bind(F.struct(T.relevance_terms(query).alias("x"), T.relevance_terms(document).alias("y")), of)


def signal_score(query: Column, kind: Column, formula: Column, api: Column, bench: Column) -> Column:
    q = F.lower(T.clean(query))
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    total = (
        add(kind == "signal", 0.03) + add(formula & q.rlike(r"\b(equation|formula|math|mathematical|derive|softmax|sqrt|sum|matrix)\b"), 0.12)
        + add(api & q.rlike(r"\b(api|sdk|pytorch|tensorflow|torch\.|tf\.|keras\.)\b"), 0.10) + add(bench & q.rlike(r"\b(benchmark|score|accuracy|bleu|glue|imagenet|metric)\b"), 0.10)
    )
    return F.least(total, F.lit(0.20))


def fuse(semantic_hits: DataFrame, lexical_hits: DataFrame, weights: tuple[float, float] = (SEMANTIC, BM25)) -> DataFrame:
    """(query_id, id, semantic_score, bm25_score, score) of two ranked lists (query_id, id, rank, score): semantic scores and reciprocal lexical ranks, scaled within each query, weighted."""
    a = minmax(semantic_hits, "query_id", "score", "semantic_score").select("query_id", "id", "semantic_score")
    b = minmax(lexical_hits.withColumn("r", 1.0 / F.col("rank")), "query_id", "r", "bm25_score").select("query_id", "id", "bm25_score")
    both = a.join(b, ["query_id", "id"], "full").fillna(0.0, ["semantic_score", "bm25_score"])
    return both.withColumn("score", F.round(weights[0] * F.col("semantic_score") + weights[1] * F.col("bm25_score"), DIGITS))


def rank_fused(fused: DataFrame, about: DataFrame) -> DataFrame:
    """fuse()'s rows with the whole score: source authority, the query's features in the document and its signals added. about: (query_id, id, query, document, authority, signal), a row for each candidate that has a text; others get none of the three."""
    told = about.select("query_id", "id", (AUTHORITY * F.col("authority") + FEATURE * feature_score(F.col("query"), F.col("document")) + F.col("signal")).alias("__more"))
    both = fused.join(told, ["query_id", "id"], "left")
    whole = SEMANTIC * F.col("semantic_score") + BM25 * F.col("bm25_score") + F.coalesce("__more", F.lit(0.0))
    return both.withColumn("score", F.round(whole, DIGITS)).drop("__more")


def merge_queries(hits: DataFrame, k: int) -> DataFrame:
    """The best score of each id over all queries, and by how many queries it was found."""
    best = hits.groupBy("id").agg(F.max("score").alias("score"), F.count("*").alias("n_queries"))
    return best.orderBy(F.desc("score"), "id").limit(k)


def diversify(hits: DataFrame, k: int, by: str = "query_id", url: str = "url") -> DataFrame:
    """Per query, each url's best hit first, then the others by rank, k in all; a blank url never counts as seen."""
    rn = F.row_number().over(Window.partitionBy(by, url).orderBy("rank"))
    again = F.when((F.col(url) == "") | (rn == 1), 0).otherwise(1)
    return hits.withColumn("again", again).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("again", "rank"))).filter(F.col("place") <= k)


def metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, k, retrieved, relevant, relevant_retrieved, recall_at_k, precision_at_k, mrr). Queries without relevant ids get zeros."""
    total = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    flagged = hits.select("query_id", "id", "rank").join(relevant.distinct().withColumn("ok", F.lit(1)), ["query_id", "id"], "left")
    at = flagged.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).filter("rank <= k")
    found = at.groupBy("query_id", "k").agg(F.count("*").alias("retrieved"), F.count("ok").alias("relevant_retrieved"), F.min(F.when(F.col("ok") == 1, F.col("rank"))).alias("first"))
    both = found.join(total, "query_id", "left").fillna(0, ["relevant"])
    return both.select(
        "query_id", "k", "retrieved", "relevant", "relevant_retrieved", F.when(F.col("relevant") > 0, F.round(F.col("relevant_retrieved") / F.col("relevant"), DIGITS)).otherwise(0.0).alias("recall_at_k"),
        F.round(F.col("relevant_retrieved") / F.col("retrieved"), DIGITS).alias("precision_at_k"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), DIGITS).alias("mrr"),
    )


def evaluate(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, k, retrieved, relevant, relevant_retrieved, recall_at_k, precision_at_k, mrr) of hits (query_id, id, url, rank) where chunks and addresses can be relevant: relevant has (query_id, ref), ids and canonical addresses alike. A hit with a relevant address stands for that address, any other for its id, and hits that stand for one thing count once. A query without labels has zeros."""
    told = relevant.select("query_id", F.col("ref").cast("string").alias("ref")).distinct()
    total = told.groupBy("query_id").agg(F.count("*").alias("relevant"))
    rows = hits.select("query_id", "rank", F.col("id").cast("string").alias("id"), "url")
    by_url = told.select("query_id", F.col("ref").alias("url"), F.lit(True).alias("by_url"))
    by_id = told.select("query_id", F.col("ref").alias("id"), F.lit(True).alias("by_id"))
    both = rows.join(by_url, ["query_id", "url"], "left").join(by_id, ["query_id", "id"], "left")
    both = both.select("query_id", "rank", F.when(F.col("by_url"), F.col("url")).otherwise(F.col("id")).alias("ref"), F.coalesce("by_url", "by_id", F.lit(False)).alias("ok"))
    at = both.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).filter("rank <= k")
    made = at.groupBy("query_id", "k").agg(
        F.count("*").alias("retrieved"), F.count_if("ok").alias("relevant_retrieved"), F.count_distinct("ref").alias("n"), F.count_distinct(F.when(F.col("ok"), F.col("ref"))).alias("good"),
        F.min(F.when(F.col("ok"), F.col("rank"))).alias("first"),
    )
    made = made.join(total, "query_id", "left").fillna(0, ["relevant"])
    return made.select(
        "query_id", "k", "retrieved", "relevant", "relevant_retrieved", F.when(F.col("relevant") > 0, F.round(F.col("good") / F.col("relevant"), DIGITS)).otherwise(0.0).alias("recall_at_k"),
        F.when(F.col("relevant") > 0, F.round(F.col("good") / F.col("n"), DIGITS)).otherwise(0.0).alias("precision_at_k"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), DIGITS).alias("mrr"),
    )
