"""Chunks: windows of tokens, overlap, packed blocks, parents, signal chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sources

SIZE, OVERLAP = 1200, 180
PARENT_SIZE, PARENT_OVERLAP = 3000, 240


def word_list(c: Column) -> Column:
    return F.filter(F.split(T.text(c), r"(?U)\s+"), lambda x: x != "")


def windows(df: DataFrame, keys: list[str], text: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(keys, chunk_index, n_chunks, token_count, chunk): windows of `size` tokens, each `size - overlap` after the last. Row-wise, without a shuffle; a text is cleaned once, and only cut into words if it is longer than a window."""
    step = max(1, size - overlap)
    window = lambda n, c: F.struct(n.alias("n"), c.alias("c"))

    def cut(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int")), lambda i: window(F.least(n - i * step, F.lit(size)), F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ")))

    def of(x: Column) -> Column:
        return F.when(x["n"] > size, T.bind(F.split(x["c"], " "), cut)).when(x["n"] > 0, F.array(window(x["n"], x["c"])))

    # an outer one: of others the plan takes the condition that there are any, and cuts each text once more for it
    cleaned = T.bind(T.clean(text), lambda c: window(T.clean_count(c), c))
    rows = df.select(*keys, T.bind(cleaned, of).alias("__c")).select(*keys, F.size("__c").alias("n_chunks"), F.posexplode_outer("__c").alias("chunk_index", "__x"))
    return rows.filter("chunk_index IS NOT NULL").select(*keys, "chunk_index", "n_chunks", F.col("__x.n").alias("token_count"), F.col("__x.c").alias("chunk"))


def with_overlap(chunks: DataFrame, keys: list[str], overlap: int = OVERLAP) -> DataFrame:
    """Each chunk prefixed with the last tokens of the one before it. Only these tails are moved next to their successors."""
    words = word_list(F.col("chunk"))
    tails = chunks.select(*keys, (F.col("chunk_index") + 1).alias("chunk_index"), F.array_join(F.slice(words, F.greatest(F.size(words) - overlap, F.lit(0)) + 1, overlap), " ").alias("__tail"))
    joined = chunks.join(tails, [*keys, "chunk_index"], "left")
    return joined.withColumn("chunk", F.when(F.col("__tail").isNull(), F.col("chunk")).otherwise(F.concat_ws("\n\n", "__tail", "chunk"))).drop("__tail")


def token_windows(c: Column, size: int, overlap: int) -> Column:
    """A text's windows of `size` tokens, each `size - overlap` after the last, as an array."""
    step = max(1, size - overlap)

    def of(w: Column) -> Column:
        n = F.when(F.size(w) <= size, 1).otherwise(F.ceil((F.size(w) - size) / step).cast("int") + 1)
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ")))

    return T.bind(word_list(c), of)


def packed(blocks: Column, size: int, overlap: int = 0) -> Column:
    """Blocks put together greedily up to `size` tokens each; what is larger ends the chunk before it and is cut into windows. A fold, as each step needs the last."""
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("out"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        b, k = x["b"], x["k"]
        large, begun = k > size, s["now"] != ""
        flush = begun & (large | (s["n"] + k > size))
        fresh = flush | ~begun
        out = F.concat(s["out"], F.when(flush, F.array(s["now"])).otherwise(none), F.when(large, token_windows(b, size, overlap)).otherwise(none))
        now = F.when(large, "").when(fresh, b).otherwise(F.concat(s["now"], F.lit("\n\n"), b))
        return F.struct(out.alias("out"), now.alias("now"), F.when(large, 0).when(fresh, k).otherwise(s["n"] + k).alias("n"))

    end = lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["now"])))
    told = F.transform(blocks, lambda x: T.bind(T.clean(x), lambda b: F.struct(b.alias("b"), T.clean_count(b).alias("k"))))
    return F.aggregate(F.filter(told, lambda x: x["k"] > 0), state, step, end)


def overlapped(chunks: Column, overlap: int) -> Column:
    """Chunks of one text, each after the first prefixed with the last tokens of the one before it."""
    if overlap <= 0:
        return chunks

    def of(every: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            tail = lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - overlap, F.lit(0)) + 1, F.lit(overlap)), " ")
            return F.when(i == 0, x).otherwise(F.concat(T.bind(word_list(F.get(every, i - 1)), tail), F.lit("\n\n"), T.clean(x)))

        return F.transform(every, one)

    return T.bind(chunks, of)


def structured(c: Column) -> Column:
    """A text's sections; one larger than a parent falls apart into its blocks."""
    return F.flatten(F.transform(sections(c), lambda x: F.when(T.token_count(x) <= PARENT_SIZE, F.array(x)).otherwise(blocks(x))))


def parent_texts(c: Column) -> Column:
    """The larger contexts of a cleaned text."""
    made = overlapped(packed(structured(c), PARENT_SIZE, PARENT_OVERLAP), PARENT_OVERLAP)
    return T.bind(made, lambda m: F.when(F.size(m) > 0, m).when(T.clean(c) != "", F.array(T.clean(c))).otherwise(m))


def signal_texts(c: Column, most: int, context: int = 3) -> Column:
    """The different passages of a cleaned text around lines that show a formula, an interface or a benchmark."""

    def of(lines: Column) -> Column:
        def around(x: Column, i: Column) -> Column:
            start = F.greatest(i - context, F.lit(0))
            words = word_list(F.array_join(F.slice(lines, start + 1, i + context + 1 - start), "\n"))
            return F.when(T.has_signal(x), F.array_join(F.slice(words, 1, most), " "))

        return F.array_distinct(F.filter(F.transform(lines, around), lambda x: x.isNotNull() & (x != "")))

    return T.bind(F.filter(F.split(c, "\n"), lambda x: T.clean(x) != ""), of)


def split_document(df: DataFrame, keys: list[str], text: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(keys, place, kind, chunk, token_count, the three signals, parent_index, parent_token_count, parent): a text's regular chunks, then its signal chunks, each different one once, with the parent that shares most different tokens, the first of equals. Row by row, without a shuffle."""
    size = max(100, size)
    overlap = max(0, min(overlap, size // 2))
    lower_words = lambda c: F.array_distinct(word_list(F.lower(c)))
    rows = df.select(*keys, sources.clean_text(text).alias("__c"))
    rows = rows.select(*keys, parent_texts(F.col("__c")).alias("__p"), overlapped(packed(blocks(F.col("__c")), size, overlap), overlap).alias("__r"), signal_texts(F.col("__c"), max(120, size // 2)).alias("__s"))
    of_kind = lambda kind, c: F.transform(F.array_distinct(F.col(c)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("chunk")))
    kinds = F.concat(of_kind("regular", "__r"), of_kind("signal", "__s"))
    counted = F.transform("__p", lambda p: T.bind(T.clean(p), lambda b: F.struct(b.alias("parent"), T.clean_count(b).alias("n"))))
    rows = rows.withColumn("__t", F.when(F.size("__p") > 1, F.transform("__p", lower_words))).withColumn("__p", counted).select(*keys, "__p", "__t", F.posexplode(kinds).alias("place", "x"))
    words = lower_words(F.col("x.chunk"))
    best = T.bind(words, lambda w: F.array_max(F.transform("__t", lambda p, i: F.struct(F.size(F.array_intersect(p, w)).alias("o"), (-i).alias("i")))))
    # of a single parent nothing needs to be compared
    rows = rows.withColumn("parent_index", F.when(F.col("__t").isNull(), 0).otherwise(F.coalesce(-best["i"], F.lit(0))))
    told = F.get("__p", F.col("parent_index"))
    own = T.bind(T.clean(F.col("x.chunk")), lambda b: F.struct(b.alias("parent"), T.clean_count(b).alias("n")))
    rows = rows.select(*keys, "place", "x.kind", "x.chunk", "parent_index", F.coalesce(told, own).alias("__q"))
    flags = (v.alias(k) for k, v in T.signals(F.col("chunk")).items())
    return rows.select(*keys, "place", "kind", "chunk", T.token_count(F.col("chunk")).alias("token_count"), *flags, "parent_index", F.col("__q.n").alias("parent_token_count"), F.col("__q.parent").alias("parent"))


def blocks(c: Column) -> Column:
    """A text's parts between blank lines."""
    return T.clean_list(F.split(T.text(c), r"(?U)\n\s*\n+"))


def sections(c: Column) -> Column:
    """A text cut before headings outside code fences. Fences are counted by a fold over lines."""
    lines = F.split(T.text(c), "\n")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("now"), F.lit(False).alias("fence"))

    def step(s: Column, line: Column) -> Column:
        trimmed = F.trim(line)
        fence = F.when(F.startswith(trimmed, F.lit("```")), ~s["fence"]).otherwise(s["fence"])
        new = s["now"].isNotNull() & ~fence & T.is_heading(trimmed)
        return F.struct(
            F.when(new, F.concat(s["out"], F.array(F.trim(s["now"])))).otherwise(s["out"]).alias("out"),
            F.when(new | s["now"].isNull(), F.rtrim(line)).otherwise(F.concat(s["now"], F.lit("\n"), F.rtrim(line))).alias("now"), fence.alias("fence"),
        )

    return F.filter(F.aggregate(lines, state, step, lambda s: F.concat(s["out"], F.array(F.trim(F.coalesce(s["now"], F.lit("")))))), lambda x: T.clean(x) != "")


def signal_chunks(df: DataFrame, keys: list[str], text: Column, context: int = 3, most: int = SIZE) -> DataFrame:
    """(keys, position, chunk): a line that shows a formula, an interface or a benchmark, with the lines around it; each different chunk once, at its first place."""
    rows = df.select(*keys, F.filter(F.split(T.text(text), "\n"), lambda x: T.clean(x) != "").alias("__l"))
    hit = rows.select(*keys, "__l", F.posexplode("__l").alias("position", "line")).filter(F.col("line").rlike(T.SIGNAL))
    start = F.greatest(F.col("position") - context, F.lit(0))
    around = T.clean(F.array_join(F.slice("__l", start + 1, F.col("position") + context + 1 - start), "\n"))
    short = F.array_join(F.slice(F.split(around, " "), 1, most), " ")
    return hit.select(*keys, "position", short.alias("chunk")).filter("chunk <> ''").groupBy(*keys, "chunk").agg(F.min("position").alias("position"))


def parented_windows(df: DataFrame, keys: list[str], text: Column, size: int = SIZE, overlap: int = OVERLAP, parent_size: int = PARENT_SIZE, parent_overlap: int = PARENT_OVERLAP) -> DataFrame:
    """(keys, chunk_index, n_chunks, token_count, chunk, parent_index, parent): windows() with their parents as assign_parents() chooses them among a text's larger windows, of one table and so row by row, without a shuffle."""
    terms = lambda c: F.array_distinct(T.tokens(c))
    rows = df.select(*keys, token_windows(text, size, overlap).alias("__c"), token_windows(text, parent_size, parent_overlap).alias("__p"))
    # a text of one parent needs no terms
    rows = rows.withColumn("__t", F.when(F.size("__p") > 1, F.transform("__p", terms))).withColumn("n_chunks", F.size("__c")).select(*keys, "n_chunks", "__p", "__t", F.posexplode("__c").alias("chunk_index", "chunk"))
    best = T.bind(terms(F.col("chunk")), lambda w: F.array_max(F.transform("__t", lambda p, i: F.struct(F.size(F.array_intersect(w, p)).alias("o"), (-i).alias("i")))))
    rows = rows.withColumn("parent_index", F.when(F.col("__t").isNull(), 0).otherwise(-best["i"]))
    return rows.select(*keys, "chunk_index", "n_chunks", T.token_count(F.col("chunk")).alias("token_count"), "chunk", "parent_index", F.get("__p", F.col("parent_index")).alias("parent"))


def assign_parents(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Each child chunk with the parent window of its text that shares the most different tokens with it, the first of equals; without any parent, number 0 and the child itself. Tokens are compared by text, and only the chosen parents' texts are joined."""
    terms = lambda c: F.array_distinct(T.tokens(F.col(c)))
    asked = children.select(*keys, "chunk_index", terms("chunk").alias("__t"))
    told = parents.select(*keys, F.col("chunk_index").alias("parent_index"), terms("chunk").alias("__p"))
    overlap = F.size(F.array_intersect("__t", "__p"))
    best = asked.join(told, keys).groupBy(*keys, "chunk_index").agg(F.max_by("parent_index", F.struct(overlap, -F.col("parent_index"))).alias("parent_index"))
    both = children.join(best, [*keys, "chunk_index"], "left").withColumn("parent_index", F.coalesce("parent_index", F.lit(0)))
    texts = parents.select(*keys, F.col("chunk_index").alias("parent_index"), F.col("chunk").alias("parent"))
    return both.join(texts, [*keys, "parent_index"], "left").withColumn("parent", F.coalesce("parent", "chunk"))
