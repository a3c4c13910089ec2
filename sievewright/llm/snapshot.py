"""The difference of two snapshots of a table, in which rows may have changed their keys.

Rows become narrow first: a digest of each compared column, one of all of them (the content), and the later row's
checksum. Texts never move. A first cogroup, on buckets of hashed keys, merges the two snapshots' keys with pandas.
What it leaves unpaired goes to a second cogroup, on buckets of hashed contents, which sorts the earlier keys of a
content upwards and the later ones downwards, counts both (cumcount), and merges equal counts.

A content that very many rows share would make one bucket of all of them. So the unpaired rows are dealt to ranges of
their keys, each range's rows of a content are counted, and sums over the ranges before give every row its place in its
content. BLOCK places of a content go to a bucket together, and the same places of both snapshots meet in it.

Repeated keys: the rows of a key in a snapshot are numbered in the order of their contents, and equal numbers pair.
Equal rows are counted before they are numbered, so that a key with very many rows is no large group either.

Defined cases: nulls equal only nulls, in keys too; empty texts and texts of any length are compared by 128 bits of
their digests; columns that are not compared are ignored, whatever their names; an empty snapshot gives inserts or
deletes only; compared columns of other types are compared and summed up as strings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged

COMPARED = ("text", "lang", "source")
#: Places of one content that go to a bucket together, and rows that a bucket has about.
BLOCK, ROWS = 1_000, 10_000
#: Buckets for each shuffle partition at least, so that they fill partitions evenly.
SPREAD = 4
EARLIER, LATER, PAIR = 0, 1, 2
_KEY = ["k", "unknown", "nth"]
RESULT = "key long, old_key long, op string, changed string, row_sha256 string"


def _digest(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("~")).otherwise(F.substring(F.sha2(c, 256), 1, 32))


def _narrow(df: DataFrame, key: str, columns: Sequence[str], later: bool) -> DataFrame:
    """(k, unknown: the key is null, d0, d1, ...: digests, content, row_sha256 of the later)."""
    text = [F.col(c).cast("string") for c in columns]
    whole = F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in text))
    k = F.col(key).cast("long")
    own = [F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("unknown"), (F.sha2(whole, 256) if later else F.lit("")).alias("row")]
    digests = [f"d{i}" for i in range(len(columns))]
    out = df.select(*own, *(_digest(c).alias(d) for c, d in zip(text, digests, strict=True)))
    return out.withColumn("content", F.substring(F.sha2(F.concat(*digests), 256), 1, 32))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with their number (nth) among the rows of their key, 0 unless the key is repeated."""
    repeated = rows.groupBy("k", "unknown").agg(F.count("*").alias("n")).filter("n > 1").select("k", "unknown")
    if repeated.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    single = rows.join(repeated, ["k", "unknown"], "left_anti").withColumn("nth", F.lit(0).cast("long"))
    # equal rows are one row with a count; a key's contents are summed up by ranges of their digests, then within each
    copies = rows.join(repeated, ["k", "unknown"], "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("range", F.substring("content", 1, 3))
    ranges = copies.groupBy("k", "unknown", "range").agg(F.sum("n").alias("held"))
    ranges = ranges.withColumn("before", F.sum("held").over(Window.partitionBy("k", "unknown").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).drop("held")
    within = Window.partitionBy("k", "unknown", "range").orderBy("content").rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.withColumn("own", F.sum("n").over(within) - F.col("n")).join(ranges, ["k", "unknown", "range"]).withColumn("first", F.col("before") + F.col("own"))
    # copies come back in two steps, so that no task makes all rows of a key
    blocks = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long")))).repartition("k", "unknown", "content", "at")
    each = F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + BLOCK, "n") - 1))
    return single.unionByName(blocks.select(*rows.columns, each.alias("nth")))


def _buckets(df: DataFrame, rows: int) -> int:
    return max(SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS))


def _meet(old: DataFrame, new: DataFrame, bucket: Column, merge, schema: str) -> DataFrame:
    old, new = (df.select(*(F.col(c).alias(c) for c in df.columns)).withColumn("bucket", bucket) for df in (old, new))  # columns of their own, as both may come from one table
    return old.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(merge, schema)


def _places(loose: DataFrame) -> DataFrame:
    """loose with each row's place in its content: upwards by key in the earlier snapshot, downwards in the later one."""
    parts = int(loose.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k", "unknown", "nth"]
    dealt = staged(loose.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "snapshot-loose")
    by = ["side", "content", "range"]
    down = F.col("side") == LATER
    counts = dealt.groupBy(*by).agg(F.count("*").alias("held"))
    before = Window.partitionBy("side", "content").orderBy(F.when(down, -F.col("range")).otherwise(F.col("range"))).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("before", F.sum("held").over(before) - F.col("held")).drop("held")
    within = Window.partitionBy(*by).orderBy(*(F.when(~down, F.col(c)).asc() for c in order), *(F.when(down, F.col(c)).desc() for c in order))
    return dealt.join(counts, by).withColumn("place", F.col("before") + F.row_number().over(within) - 1).drop("before", "range")


def diff(old: DataFrame, new: DataFrame, key: str = "doc_id", columns: Sequence[str] = COMPARED) -> DataFrame:
    """(key, old_key, op, changed, row_sha256): a row for each pair and each row without a partner."""
    columns = tuple(columns)
    digests = [f"d{i}" for i in range(len(columns))]
    ship(old.sparkSession)
    sides = [_numbered(staged(_narrow(df, key, columns, later), "snapshot-rows")) for df, later in ((old, False), (new, True))]

    def by_key(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        both = a.drop(columns=["bucket", "row"]).merge(b.drop(columns="bucket"), on=_KEY, how="outer", suffixes=("", "_new"), indicator="found")
        one, two = both["found"] == "left_only", both["found"] == "both"
        differ = [two & (both[d] != both[f"{d}_new"]) for d in digests]
        changed = [",".join(n for n, x in zip(columns, row, strict=True) if x) for row in zip(*differ, strict=True)]
        out = both[_KEY].copy()
        out["side"] = two * PAIR + (~one & ~two) * LATER
        out["content"] = both["content"].where(one, both["content_new"])
        out["row"] = both["row"].fillna("")
        out["changed"] = changed
        return out

    rows = sides[0].count() + sides[1].count()
    merged = _meet(*sides, F.pmod(F.xxhash64("k", "unknown", F.floor(F.col("nth") / BLOCK)), F.lit(_buckets(old, rows))), by_key, "k long, unknown boolean, nth long, side int, content string, row string, changed string")
    merged = staged(merged, "snapshot-keys", by="side")
    known = lambda c, unknown: F.when(~F.col(unknown), F.col(c))
    op = F.when(F.col("changed") == "", "same").otherwise("update")
    paired = merged.filter(F.col("side") == PAIR).select(known("k", "unknown").alias("key"), known("k", "unknown").alias("old_key"), op.alias("op"), "changed", F.col("row").alias("row_sha256"))

    loose = merged.filter(F.col("side") != PAIR).drop("changed")
    placed = _places(loose).withColumn("block", F.floor(F.col("place") / BLOCK))
    at = F.pmod(F.xxhash64("content", "block"), F.lit(_buckets(old, loose.count())))

    def by_content(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(_KEY, ascending=True), b.sort_values(_KEY, ascending=False)
        on = ["content", "block", "i"]
        for x in (a, b):
            x["i"] = x.groupby(["content", "block"]).cumcount()
            x["known"] = ~x["unknown"]
            x["key"] = x["k"].astype("Int64").where(x["known"])  # an integer that may be null
        both = a[[*on, "key"]].merge(b[[*on, "key", "row"]], on=on, how="outer", suffixes=("_old", ""), indicator="found")
        op = both["found"].map({"left_only": "delete", "right_only": "insert", "both": "rekey"}).astype(object)
        gone = both["found"] == "left_only"
        out = pd.DataFrame({"key": both["key"].where(~gone, both["key_old"]), "old_key": both["key_old"], "op": op, "row_sha256": both["row"].where(~gone, None)})
        out.insert(3, "changed", "")
        return out

    return paired.unionByName(_meet(placed.filter(F.col("side") == EARLIER), placed.filter(F.col("side") == LATER), at, by_content, RESULT))


def later_snapshot(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The later snapshot that the registered query compares with: dropped, changed, swapped, rekeyed and copied rows by the key's checksum; rows with a null key stay as they are."""
    rest = F.coalesce(F.crc32(F.col(key).cast("string")) % 10, F.lit(-1))
    lang, source = F.col("lang"), F.col("source")
    moved = F.col("__r").isin(3, 4) | F.col("__copy")
    copies = F.explode(F.when(F.col("__r") == 5, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = docs.select(key, "text", "lang", "source").withColumn("__r", rest).filter("__r <> 0").withColumn("__copy", copies)
    return rows.select(
        F.when(moved, -1 - F.col(key)).otherwise(F.col(key)).alias(key), F.when(F.col("__r") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("__r") == 2, source).otherwise(lang).alias("lang"), F.when(F.col("__r") == 2, lang).when(F.col("__r") != 4, source).alias("source"),
    )
