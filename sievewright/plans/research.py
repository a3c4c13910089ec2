"""The research run: pages to sources, diff against the last run, chunks, retrieval, evidence. Each step is a plan; the driver only orders them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import changes, chunking, retrieval


def page_sources(pages: DataFrame) -> DataFrame:
    """(url, title, content, source_quality) of raw pages, one row for each canonical address."""
    from ..operators.pages import no_task, quality_note
    from ..operators.sources import keep_first

    made = pages.select("page_id", U.source(F.col("url")).alias("url"), T.html_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("content")).filter("url <> ''")
    first = keep_first(made, F.col("url"), "page_id")
    return first.withColumn("source_quality", quality_note(F.col("title"), F.substring("content", 1, 500), F.col("content"), F.col("url"), no_task()))


def run(pages: DataFrame, previous: DataFrame | None, questions: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """The tables of one run: sources, diff, chunks, hits. questions: (query_id, text)."""
    sources = page_sources(pages)
    out = {"sources": sources}
    if previous is not None:
        out["diff"] = changes.diff_runs(previous, sources)
    chunks = chunking.windows(sources.withColumn("key", F.lit("run")), ["key", "url"], F.col("content"))
    out["chunks"] = chunks.withColumn("chunk_id", T.chunk_id(F.col("key"), F.col("url"), F.col("chunk_index")))
    out["hits"] = retrieval.bm25(out["chunks"].select("chunk_id", F.col("chunk").alias("text")), questions, k, "chunk_id")
    return out
