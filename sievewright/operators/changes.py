"""Change detection between two runs, history and index upkeep."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed words that make a changed line important.
IMPORTANT = (
    "price", "pricing", "tier", "model", "benchmark", "score", "accuracy", "bleu", "latency", "token", "limit", "feature", "launch", "deprecated", "removed", "added", "attention",
    "architecture", "training", "dataset", "result",
)


def diff_runs(previous: DataFrame, current: DataFrame, key: str = "url") -> DataFrame:
    """(key, change, previous_hash, new_hash, previous_length, new_length, quality_changed) by a full outer join of runs (key, content, source_quality)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        content = T.clean(F.col("content"))
        return df.select(key, T.content_hash(content).alias(f"{name}_hash"), F.length(content).alias(f"{name}_length"), F.col("source_quality").alias(f"{name}_quality"))

    both = side(previous, "previous").join(side(current, "new"), key, "full")
    change = F.when(F.col("previous_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("previous_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    differs = F.coalesce(F.col("previous_quality") != F.col("new_quality"), F.lit(False))
    return both.select(key, change.alias("change"), "previous_hash", "new_hash", "previous_length", "new_length", differs.alias("quality_changed"))


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def merge_history(history: DataFrame, diff: DataFrame, at: Column, key: str = "url") -> DataFrame:
    """(key, content_hash, active, first_change) after a run: added and changed rows are written, removed ones stay inactive, unchanged ones stay. Deletes are soft and a returning key is active again."""
    rows = history.join(diff, key, "full")
    active = F.when(F.col("change") == "removed", F.lit(False)).when(F.col("change").isNotNull(), F.lit(True)).otherwise(F.col("active"))
    return rows.select(key, F.coalesce("new_hash", "content_hash").alias("content_hash"), active.alias("active"), F.when(F.col("change").isin("added", "changed", "removed"), at).otherwise(F.col("updated_at")).alias("updated_at"))


def index_plan(indexed: DataFrame, current: DataFrame, version: int, key: str = "url") -> DataFrame:
    """(key, action): skip if hash and schema version agree, replace if the key is stored otherwise, else add. One join, no lookups."""
    both = current.select(key, F.col("content_hash").alias("new_hash")).join(indexed.select(key, "content_hash", "schema_version"), key, "left")
    same = (F.col("content_hash") == F.col("new_hash")) & (F.col("schema_version") == version)
    return both.select(key, F.when(F.col("content_hash").isNull(), "add").when(same, "skip").otherwise("replace").alias("action"))


def line_diff(pairs: DataFrame, key: str = "url", limit: int = 20, objective: str = "") -> DataFrame:
    """(key, sign, place, line): the different important lines of the unified diff of columns previous and current, the first `limit` of each sign. A line is important if it holds one of the fixed words or a word of the objective longer than three characters. Python, as Spark has no diff; each pair is one row, so no group is built."""
    wanted = tuple({*IMPORTANT, *(w for w in re.findall(r"[a-z0-9_]+", objective.lower()) if len(w) > 3)})

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, a, b in zip(pdf[key], pdf["previous"], pdf["current"], strict=True):
                told: dict[str, list[str]] = {"+": [], "-": []}
                for x in difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm=""):
                    line, held = " ".join(x[1:].split()), told.get(x[:1])
                    if held is not None and not x.startswith(("+++", "---")) and line and len(held) < limit and line not in held and any(w in line.lower() for w in wanted):
                        held.append(line[:700])
                out += [(k, sign, n, line) for sign, held in told.items() for n, line in enumerate(held)]
            yield pd.DataFrame(out, columns=[key, "sign", "place", "line"])

    return pairs.select(key, "previous", "current").mapInPandas(run, f"{key} {pairs.schema[key].dataType.simpleString()}, sign string, place int, line string")


def regroup_history(history: DataFrame) -> DataFrame:
    """(objective_key, result, sources): the active rows (objective_key, task_id, url, source, active) of a history put together again, by task, or by address where a row has none; sources in order of task and address."""
    rows = history.filter("active").withColumn("result", F.coalesce(F.nullif(T.clean(F.col("task_id")), F.lit("")), T.clean(F.col("url"))))
    return rows.groupBy("objective_key", "result").agg(F.transform(F.array_sort(F.collect_list(F.struct("task_id", "url", "source"))), lambda x: x["source"]).alias("sources"))


def compatible_keys(asked: DataFrame, history: DataFrame) -> DataFrame:
    """(objective_key, lookup_key) for asked objectives (objective_key, objective): the key itself if the history has active rows of it, else the least key whose objective has the same identity, else itself."""
    known = history.filter("active").select("objective_key", "objective").distinct()
    own = known.select("objective_key").distinct().withColumn("__own", F.lit(True))
    identity = F.array_join(T.identity_terms(F.col("objective")), ":").alias("__id")
    others = known.select(identity, "objective_key").groupBy("__id").agg(F.min("objective_key").alias("__other"))
    both = asked.select("objective_key", identity).join(own, "objective_key", "left").join(others, "__id", "left")
    return both.select("objective_key", F.when(F.col("__own"), F.col("objective_key")).otherwise(F.coalesce("__other", "objective_key")).alias("lookup_key"))


def with_status(rows: DataFrame, diff: DataFrame, key: str = "url") -> DataFrame:
    """Rows with the change status of their address; those that the diff doesn't name are unchanged."""
    return rows.join(diff.select(key, F.col("change").alias("change_status")), key, "left").fillna("unchanged", ["change_status"])
