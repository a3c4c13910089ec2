"""Sources: cleaning, consolidation, duplicates, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def clean_lines(c: Column) -> Column:
    """The lines of a text that the noise and repeat rules keep, as (pos, line); blank lines stay.

    A line goes if it names a noise phrase within 18 tokens or starts as navigation does; of the others, a key of up to
    four characters stays once, and a line of up to 24 tokens twice. The running counts of the sequential rule become a
    look at the lines one and two places before, once lines are sorted by key and place: no fold, and no shuffle.
    """
    whole = F.regexp_replace(T.text(c), r"\r\n?", "\n")
    whole = F.regexp_replace(whole, r"(?i)https?://\S+\.(?:png|jpg|jpeg|gif|svg|webp)\S*", "")
    lines = F.transform(F.split(whole, "\n"), lambda x, i: F.struct(T.clean(x).alias("line"), i.alias("pos")))
    keyed = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_replace(F.lower(x["line"]), r"(?U)\W+", " ")).alias("key"), x["pos"].alias("pos"), x["line"].alias("line"), T.clean_count(x["line"]).alias("n")))

    def passes(x: Column) -> Column:
        navigation = F.lit(False)
        for start in T.NAVIGATION:
            navigation = navigation | F.startswith(x["key"], F.lit(start))
        return (x["key"] == "") | ~(((x["n"] <= 18) & x["line"].rlike(rf"(?i)\b({T.NOISE})\b")) | navigation)

    def repeats(every: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            new = lambda k: (i < k) | (F.get(every, i - k)["key"] != x["key"])
            return (x["key"] == "") | F.when(F.length(x["key"]) <= 4, new(1)).otherwise(new(2) | (x["n"] > 24))

        return F.filter(every, stays)

    kept = T.bind(F.array_sort(F.filter(keyed, passes)), repeats)
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"))))


def clean_text(c: Column) -> Column:
    """A text of the lines that clean_lines() keeps, with one blank line at most between two others."""
    joined = F.array_join(F.transform(clean_lines(c), lambda x: x["line"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def clean_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): the lines of each row's text that clean_lines() keeps, without blank ones."""
    lines = df.select(id_col, F.explode(clean_lines(F.col(text_col))).alias("x"))
    return lines.select(id_col, F.col("x.pos").alias("line_no"), F.col("x.line").alias("line")).filter("line <> ''")


def consolidate(df: DataFrame, key: str, order: str, content: Column, attributes: dict[str, Column], lists: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """One record for each key: the longest content (the first of equals), how many rows it stands for, and their attributes and lists.

    Rows that set a new record of length, in order, may give attributes; of those, the last non-blank value stays, and the
    first row's where all are blank. lists: (value, separator) of which all different non-blank values are put together in
    order. Contents are reduced by an aggregate; only lengths and attributes are put in order within a key.
    """
    lists = lists or {}
    rows = df.select(key, F.col(order).alias("__o"), content.alias("content"), *(T.clean(c).alias(n) for n, c in attributes.items()), *(T.clean(c).alias(n) for n, (c, _) in lists.items())).filter("content <> ''")
    best = F.max_by("content", F.struct(F.length("content"), -F.col("__o")))
    made = rows.groupBy(key).agg(best.alias("content"), F.count("*").alias("n_rows"), F.min("__o").alias("first_seen"))
    w = Window.partitionBy(key).orderBy("__o")
    slim = rows.select(key, "__o", F.length("content").alias("__n"), *attributes)
    sets = slim.withColumn("__top", F.max("__n").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("__top IS NULL OR __n > __top")
    last = sets.groupBy(key).agg(*(F.coalesce(F.max_by(n, F.when(F.col(n) != "", F.col("__o"))), F.lit("")).alias(n) for n in attributes)) if attributes else None
    out = made.join(last, key) if attributes else made
    for n, (_, separator) in lists.items():
        firsts = rows.filter(F.col(n) != "").groupBy(key, n).agg(F.min("__o").alias("__o"))
        told = firsts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", F.col(n).alias("v")))), lambda x: x["v"]), separator).alias(n))
        out = out.join(told, key, "left").fillna("", [n])
    return out.select(key, "content", *attributes, *lists, "n_rows", "first_seen", T.content_hash(F.col("content")).alias("content_hash"))


def exact_duplicates(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(content_hash, keep, copies) for contents that occur more than once."""
    return df.select(F.col(id_col).alias("__id"), T.content_hash(content).alias("content_hash")).groupBy("content_hash").agg(F.min("__id").alias("keep"), F.count("*").alias("copies")).filter("copies > 1")


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key."""
    every = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(key.alias("__k")).agg(F.min_by(every, F.col(order)).alias("r")).select("r.*")
