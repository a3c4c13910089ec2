"""Upkeep of research runs: status changes, alignment, scopes, parents, refreshed coverage, citations and context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .reports import replace_each

STRONG, PARTIAL = 0.75, 0.4
LOOKED_AT = 3_000


def latest(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of each key's rows the last one."""
    whole = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("__k")).agg(F.max_by(whole, F.col(position)).alias("r")).select("r.*")


def status_changes(previous: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """(key, previous_value, new_value) of keys that both runs have with different values; keys are unique in a run."""
    a = previous.select(key, T.clean(F.col(value)).alias(f"previous_{value}"))
    b = current.select(key, T.clean(F.col(value)).alias(f"new_{value}"))
    return a.join(b, key).filter(F.col(f"previous_{value}") != F.col(f"new_{value}"))


def task_status(sources: Column, errors: Column) -> Column:
    """From the numbers of a task's sources and errors."""
    return F.when(F.coalesce(sources, F.lit(0)) == 0, "failed").when(errors > 0, "partial").otherwise("success")


def alignment(sources: DataFrame, by: list[str], text: Column, objective: str) -> DataFrame:
    """(by, n_sources, n_matches, alignment): how many sources have one of the objective's words of over three characters. The objective is one short text of the run."""
    terms = list(dict.fromkeys(w for w in objective.lower().replace("-", " ").split() if len(w) > 3))
    body = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, LOOKED_AT))
    found = reduce(lambda a, w: a | F.contains(body, F.lit(w)), terms, F.lit(False))
    made = sources.groupBy(*by).agg(F.count("*").alias("n_sources"), F.count_if(found).alias("n_matches"))
    share = F.col("n_matches") / F.col("n_sources")
    said = F.when(share >= STRONG, "strong").when(share >= PARTIAL, "partial").otherwise("weak") if terms else F.lit("unknown")
    return made.withColumn("alignment", said)


def valid_query(c: Column) -> Column:
    """Three words or more, and not a placeholder."""
    text = T.clean(c)
    placeholder = F.lower(text).rlike(r"^(?:(?:query|retrieval query|search query|example query)\s*[0-9]*|(?:query|retrieval|search|example)(?:\s+[0-9]+)?)$")
    return (F.size(F.filter(F.split(text, " "), lambda w: w != "")) >= 3) & ~placeholder


def expand_parents(hits: DataFrame, parents: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hits (by, id, rank, document, parent_id) with the parent's text where it has more tokens, one hit for each parent, the best. parents: (parent_id, content)."""
    both = hits.join(parents.select("parent_id", "content"), "parent_id", "left")
    n = lambda c: F.size(T.tokens(F.col(c)))
    both = both.withColumn("expanded", F.coalesce(n("content") > n("document"), F.lit(False)))
    context = F.when(F.col("expanded"), F.concat(F.lit("p"), F.col("parent_id").cast("string"))).otherwise(F.concat(F.lit("c"), F.col("id").cast("string")))
    first = F.row_number().over(Window.partitionBy(*by, context).orderBy("rank"))
    text = F.when(F.col("expanded"), F.col("content")).otherwise(F.col("document"))
    return both.withColumn("__r", first).filter("__r = 1").withColumn("document", text).select(*hits.columns, "expanded")


def question_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(T.clean(c), "[^a-zA-Z0-9]+", " ")))


def merge_coverage(original: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Refreshed answers (question, status, position) replace the original ones of the same question, others follow them. Of a question's refreshed rows the last counts; a question without letters or digits is never replaced."""
    key = question_key(F.col("question"))
    a = original.select(key.alias("k"), F.col("question").alias("q0"), F.col("status").alias("s0"), F.col("position").alias("p0"))
    last = latest(refreshed.withColumn("k", key).filter("k <> ''"), "k", "position")
    b = last.select("k", F.col("question").alias("q1"), F.col("status").alias("s1"), F.col("position").alias("p1"))
    both = a.join(b, "k", "full")
    return both.select(F.coalesce("q1", "q0").alias("question"), F.coalesce("s1", "s0").alias("status"), F.col("p0").isNull().cast("int").alias("appended"), F.coalesce("p0", "p1").alias("position"))


def remap_citations(c: Column, places: Column) -> Column:
    """Text with every [old] put as [new] by a map of strings; markers that the map lacks stay."""
    return replace_each(c, r"\[([0-9]+)\]", lambda m: F.concat(F.lit("["), F.coalesce(F.element_at(places, m), m), F.lit("]")))


def merge_context(groups: list[DataFrame], key: str = "id") -> DataFrame:
    """The groups' rows in order, of each id the first. Groups are (id, rank, ...) with the same columns."""
    rows = reduce(DataFrame.unionByName, [g.withColumn("group", F.lit(k)) for k, g in enumerate(groups)])
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("group", "rank"))).filter("__r = 1").drop("__r")


def missing_urls(planned: DataFrame, covered: DataFrame, key: str = "url") -> DataFrame:
    return planned.join(covered.select(key), key, "left_anti")
