"""Audits of cited sources, and a text's headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def citation_audit(df: DataFrame, key: list[str], text: Column, n_sources: Column) -> DataFrame:
    """(key, cited, valid, invalid, uncited) as sorted arrays; sources are numbered from 1."""
    cited = F.array_sort(F.array_distinct(T.citations(text)))
    known = F.sequence(F.lit(1), n_sources)
    return df.select(*key, cited.alias("cited"), F.array_intersect(cited, known).alias("valid"), F.array_except(cited, known).alias("invalid"), F.array_except(known, cited).alias("uncited"))


def headings(df: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key, line_no, level, heading): Markdown headings outside code fences, normalised. Fence parity is a running sum over a text's lines."""
    lines = df.select(*key, F.posexplode(F.split(T.text(text), "\n")).alias("line_no", "line"))
    fence = F.sum(F.when(F.startswith(F.trim("line"), F.lit("```")), 1).otherwise(0)).over(Window.partitionBy(*key).orderBy("line_no"))
    found = lines.withColumn("fences", fence).filter((F.col("fences") % 2 == 0) & F.col("line").rlike(r"^#{1,6}\s+\S"))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), r"^#+\s+(\d+[.)]\s*)?", ""), r"[*_`:]+", ""))
    return found.select(*key, "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), name.alias("heading"))
