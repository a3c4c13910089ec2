"""Interfaces to services outside: search, pages, models, encoders, memory. What is here runs offline; a deployment brings its own."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..functions import urls as U


class Search(Protocol):
    def search(self, query: str, limit: int) -> list[dict]: ...


class Completion(Protocol):
    def complete(self, messages: Sequence[dict]) -> str: ...


class TableSearch:
    """Search over a table (url, title, content): pages that hold most of a query's terms."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def search(self, query: str, limit: int = 3) -> list[dict]:
        asked = T.relevance_terms(F.lit(query))
        hits = F.size(F.array_intersect(asked, T.relevance_terms(F.concat_ws(" ", "title", "content"))))
        return [r.asDict() for r in self.pages.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "url").limit(limit).collect()]


class EchoModel:
    """A stand-in for a language model: the first sentence of the last message."""

    def complete(self, messages: Sequence[dict]) -> str:
        return messages[-1]["content"].split(".")[0] if messages else ""


def complete_with_retries(model: Completion, messages: list[dict], tries: int = 3, wait: float = 0.0) -> str:
    """Ask again with the longest user message cut to three quarters when a request is too large or too frequent; other errors are raised."""
    messages = [dict(m) for m in messages]  # the caller's own stay as they are
    for k in range(tries):
        try:
            return model.complete(messages)
        except Exception as e:
            if k == tries - 1 or not any(x in str(e).lower() for x in ("too large", "rate limit", "413", "429")):
                raise
            users = [m for m in messages if m.get("role") == "user"]
            if users:
                longest = max(users, key=lambda m: len(m["content"]))
                keep = int(len(longest["content"]) * 0.75) // 2
                longest["content"] = longest["content"][:keep] + "\n...\n" + longest["content"][-keep:]
            time.sleep(wait)
    raise AssertionError("unreachable")


def hashed_vector(c: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an encoder: L2-normalised counts of terms by hash."""
    words = F.transform(T.tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(words, lambda w: w == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm)).otherwise(counts)


def search_results(df: DataFrame, json_col: str) -> DataFrame:
    """(url, title, content) of JSON search responses; rows without url go, a snippet stands in for missing content."""
    rows = df.select(F.explode(F.from_json(json_col, "results array<struct<url:string,title:string,content:string,snippet:string>>")["results"]).alias("r")).select("r.*")
    return rows.filter(T.clean(F.col("url")) != "").select("url", T.clean(F.col("title")).alias("title"), T.clean(F.coalesce("content", "snippet")).alias("content"))


class Memory:
    """Small JSON state on the driver: replaced in one step; a broken file counts as empty."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as held:
                found = json.load(held)
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def set(self, key: str, value: object) -> None:
        state = self.load() | {key: value}
        temporary = f"{self.path}.{hashlib.sha256(str(time.time_ns()).encode()).hexdigest()[:8]}"
        with open(temporary, "w", encoding="utf-8") as out:
            json.dump(state, out)
        os.replace(temporary, self.path)

    def get(self, key: str, default: object = None) -> object:
        return self.load().get(key, default)


class ChunkStore:
    """Chunks (history_key, url, ...) as Parquet. Each write adds one batch, whose rows carry its number, and a list of the addresses that it replaces; a row counts if no later batch replaces its address within its key. So a rerun doubles nothing, and no file is rewritten until compact()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _batches(self) -> int:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(f"{self.path}/gone")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []
        return max((int(n[6:]) for n in names if n.startswith("batch=")), default=0)

    def read(self, schema, key: str | None = None) -> DataFrame:
        n = self._batches()
        if not n:
            return self.spark.createDataFrame([], schema)
        numbers = range(1, n + 1)
        gone = self.spark.read.schema("history_key string, url string, batch int").option("basePath", f"{self.path}/gone").parquet(*(f"{self.path}/gone/batch={k}" for k in numbers))
        last = gone.groupBy("history_key", "url").agg(F.max("batch").alias("__last"))
        rows = self.spark.read.schema(S.StructType([*(f for f in schema.fields if f.name != "batch"), S.StructField("batch", S.IntegerType())])).option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/batch={k}" for k in numbers))
        rows = rows.filter(F.col("history_key") == key) if key else rows
        return rows.join(last, ["history_key", "url"], "left").filter("__last IS NULL OR batch >= __last").select(*(c for c in schema.names if c != "batch"))

    def write(self, chunks: DataFrame) -> None:
        """Put chunks in place of all that is stored for their addresses."""
        self._add(chunks, chunks.select("history_key", "url").distinct())

    def delete(self, sources: DataFrame) -> None:
        """Forget the chunks of addresses (history_key, url)."""
        self._add(None, sources.select("history_key", "url").distinct())

    def _add(self, chunks: DataFrame | None, gone: DataFrame) -> None:
        k = self._batches() + 1
        if chunks is None:
            chunks = gone.limit(0)
        chunks.write.mode("overwrite").parquet(f"{self.path}/rows/batch={k}")
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/batch={k}")  # last: a batch counts once this is there


class Pages:
    """Page fetches answered from a table (url, html): the offline stand-in for a fetching client."""

    def __init__(self, pages: DataFrame):
        self.pages = pages.select(U.canonical(F.col("url")).alias("url"), "html")

    def fetch(self, urls: DataFrame) -> DataFrame:
        """(url, title, content, alive) for each asked address (url)."""
        first = self.pages.groupBy("url").agg(F.min("html").alias("html"))
        both = urls.select(U.canonical(F.col("url")).alias("url")).distinct().join(first, "url", "left")
        return both.select("url", T.html_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("content"), F.col("html").isNotNull().alias("alive"))


def enabled(switches: dict, name: str, env: Callable[[str], str | None] = os.environ.get) -> bool:
    """Whether a search source is switched on: by its own flag, and only with all the settings that it requires."""
    told = switches.get(name) or {}
    return bool(told.get("enabled", True)) and all(env(x) for x in told.get("required", ()))


def write_report(report: str, objective: str, folder: str) -> str:
    """Write a report as Markdown under a name made of its objective, and give the path."""
    if not report.strip():
        raise ValueError("the report is empty")
    import re

    name = re.sub(r"[^a-z0-9]+", "-", objective.lower()).strip("-")[:80].strip("-") or "research-report"
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.md")
    with open(path, "w", encoding="utf-8") as out:
        out.write(report.strip() + "\n")
    return path


def eval_cases(rows: list[dict]) -> list[dict]:
    """Evaluation cases with lists of ids and addresses, given as lists or as comma-separated strings; those without a query go."""
    listed = lambda x: [str(v).strip() for v in (x.split(",") if isinstance(x, str) else x or []) if str(v).strip()]
    made = [{"query": " ".join(str(r.get("query") or "").split()), "relevant_ids": listed(r.get("relevant_ids")), "relevant_urls": listed(r.get("relevant_urls")), "history_key": str(r.get("history_key") or "").strip()} for r in rows]
    return [r for r in made if r["query"]]


def expand_env(value: str, env: Callable[[str], str | None] = os.environ.get) -> str:
    """${NAME} replaced by its value, unknown names by nothing."""
    import re

    return re.sub(r"\$\{(\w+)\}", lambda m: env(m[1]) or "", value)
