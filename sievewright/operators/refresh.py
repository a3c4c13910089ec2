"""What follows when a report lacks answers: tasks for the gaps alone, the report merged with its refresh, and a run's counters.

Tables hold any number of runs, by `run`; everything is a join, a window or an aggregate by run, and a run has at most some
hundred questions, sources and chunks. Defined cases: blank questions and queries make no task; a run without a refresh keeps
its rows; a source without a number has that of its position; of several refreshed sources with one number the largest new
number counts; marks and numbers that no refreshed source has stay as they are; counters of absent tables are 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import context, reports, upkeep

#: The wording of a gap's task, of its plan and of the heading over what a refresh adds.
GOAL = "Retrieve evidence needed to answer: "
INSTRUCTION = (
    "Retrieve and synthesize only the evidence needed to answer the report's missing planner "
    "sub-questions. Preserve citations and mark gaps instead of guessing."
)
HEADING = "## Targeted Evidence Refresh"
RAW_RESPONSE = 1_000


# -- the plan of a refresh ----------------------------------------------------------------------------------------------


def _ranked(df: DataFrame, name: str) -> DataFrame:
    rows = df.select("run", "place", T.clean(F.col(name)).alias(name)).filter(F.col(name) != "")
    return rows.select("run", name, F.row_number().over(Window.partitionBy("run").orderBy("place", name)).alias("position"))


def gap_tasks(missing: DataFrame, queries: DataFrame) -> DataFrame:
    """(run, position, query_context, url, source_type, extraction_goal): a task for each missing question (run, place, question). The n-th question is searched by the run's n-th query (run, place, query), or by its own words where the queries don't reach."""
    both = _ranked(missing, "question").join(_ranked(queries, "query"), ["run", "position"], "left")
    return both.select("run", "position", F.col("question").alias("query_context"), F.coalesce("query", "question").alias("url"), F.lit("rag").alias("source_type"), F.concat(F.lit(GOAL), "question").alias("extraction_goal"))


def gap_plans(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """The plans (run, objective) of the runs that have tasks, with their questions in order and the instruction for gaps."""
    asked = tasks.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "query_context"))), lambda x: x["query_context"]).alias("sub_questions"))
    return plans.select("run", T.clean(F.col("objective")).alias("objective")).join(asked, "run").withColumn("synthesis_instruction", F.lit(INSTRUCTION))


# -- the report merged with its refresh ---------------------------------------------------------------------------------


def _numbered(sources: DataFrame) -> DataFrame:
    return sources.select("run", F.coalesce(F.nullif(F.col("index"), F.lit(0)), F.col("position")).cast("long").alias("index"), "url")


def merge_sources(original: DataFrame, refreshed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sources (run, position, index, url): the merged ones (run, index, url, added), and (run, places), a map from the refresh's numbers to the merged ones, both as text. Known addresses keep their number, new ones follow the largest."""
    old = _numbered(original)
    placed = reports.append_sources(old, _numbered(refreshed), "run")
    merged = old.withColumn("added", F.lit(False)).unionByName(placed.filter("added").select("run", "index", "url", "added"))
    once = placed.groupBy("run", F.col("old_index").cast("string").alias("old")).agg(F.max("index").cast("string").alias("new"))
    return merged, once.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("places"))


def merge_answers(original: DataFrame, refreshed: DataFrame, places: DataFrame) -> DataFrame:
    """(run, synthesis, refreshed): answers (run, synthesis) with those of a refresh below a heading of their own, their citations renumbered."""
    new = refreshed.join(places, "run", "left").select("run", upkeep.remap_citations(T.clean(F.col("synthesis")), F.col("places")).alias("new"))
    both = original.join(new, "run", "left")
    added = T.clean(F.concat(T.clean(F.col("synthesis")), F.lit(f"\n\n{HEADING}\n"), F.col("new")))
    return both.select("run", F.when(F.col("new").isNotNull(), added).otherwise(F.col("synthesis")).alias("synthesis"), F.col("new").isNotNull().alias("refreshed"))


def _moved(places: Column, index: Column) -> Column:
    return F.coalesce(F.element_at(places, index.cast("string")).cast("long"), index.cast("long"))


def merge_coverage(original: DataFrame, refreshed: DataFrame, places: DataFrame) -> DataFrame:
    """(run, appended, position, question, status, source_indexes): refreshed rows, renumbered, replace a run's rows of the same question; other ones follow, in order of their first row. Of a question's refreshed rows the last counts; one without letters or digits neither replaces nor follows."""
    key = upkeep.question_key(F.col("question")).alias("k")
    moved = F.transform("source_indexes", lambda i: _moved(F.col("places"), i)).alias("source_indexes")
    new = refreshed.join(places, "run", "left").select("run", key, "position", F.struct("question", "status", moved).alias("item")).filter("k <> ''")
    new = new.groupBy("run", "k").agg(F.max_by("item", "position").alias("item"), F.min("position").alias("first"))
    old = original.select("run", key, "position", F.struct("question", "status", F.col("source_indexes").cast("array<bigint>").alias("source_indexes")).alias("own"))
    both = old.join(new, ["run", "k"], "full")
    return both.select("run", F.col("own").isNull().alias("appended"), F.coalesce("position", "first").alias("position"), F.coalesce("item", "own").alias("kept")).select("run", "appended", "position", "kept.*")


def merge_chunks(original: DataFrame, refreshed: DataFrame, places: DataFrame) -> DataFrame:
    """(run, added, position, id, source_index): supporting chunks, then those of the refresh, renumbered."""
    new = refreshed.join(places, "run", "left").select("run", F.lit(True).alias("added"), "position", "id", _moved(F.col("places"), F.col("source_index")).alias("source_index"))
    return original.select("run", F.lit(False).alias("added"), "position", "id", F.col("source_index").cast("long").alias("source_index")).unionByName(new)


def merge(original: dict[str, DataFrame], refreshed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A report's tables answers, sources, chunks and coverage with those of its refresh."""
    sources, places = merge_sources(original["sources"], refreshed["sources"])
    made = {"sources": sources, "answers": merge_answers(original["answers"], refreshed["answers"], places)}
    made["chunks"] = merge_chunks(original["chunks"], refreshed["chunks"], places)
    return made | {"coverage": merge_coverage(original["coverage"], refreshed["coverage"], places)}


# -- counters of a run --------------------------------------------------------------------------------------------------

#: The counters that are the numbers of a table's rows, by the table's name.
COUNTED = {
    "sources": "source_count", "supporting": "supporting_chunk_count", "coverage_hits": "source_coverage_count", "signals": "browser_signal_count",
    "gap_hits": "gap_retrieved_count", "history_keys": "allowed_history_key_count", "scopes": "selected_objectives",
}


def _rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The numbers of rows by run of all tables in one aggregate, partial before the shuffle."""
    tall = reduce(DataFrame.unionByName, [t.select("run", F.lit(name).alias("name")) for name, t in tables.items()])
    return tall.groupBy("run").agg(*(F.count_if(F.col("name") == name).alias(COUNTED[name]) for name in tables))


def _gaps(queries: DataFrame) -> DataFrame:
    """Gap queries (run, query, origin: llm or fallback) counted by origin, and what they come from."""
    made = queries.groupBy("run").agg(
        F.count_distinct(F.lower(T.clean(F.col("query")))).alias("gap_retrieval_query_count"),
        F.count_if(F.col("origin") == "llm").alias("llm_gap_query_count"), F.count_if(F.col("origin") == "fallback").alias("fallback_gap_query_count"),
    )
    model, rule = F.col("llm_gap_query_count") > 0, F.col("fallback_gap_query_count") > 0
    return made.withColumn("gap_query_source", F.when(model & rule, "mixed").when(model, "llm").when(rule, "fallback").otherwise("none"))


def _citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    known = sources.groupBy("run").agg(F.collect_set(F.col("index").cast("int")).alias("known"))
    cited = F.array_distinct(T.citations(reports.normal_citations(F.col("synthesis"))))
    both = answers.select("run", cited.alias("cited")).join(known, "run", "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))
    return both.select("run", F.size(F.array_except("cited", "known")).alias("invalid_citation_count"), F.size(F.array_intersect("cited", "known")).alias("cited_source_count"))


def counters(answers: DataFrame, hits: DataFrame, tables: dict[str, DataFrame], gap_queries: DataFrame, gap_plans: DataFrame) -> DataFrame:
    """One row of diagnostics for each answer (run, synthesis).

    hits: the context the answer is from, as in `context`. tables: any of COUNTED, `sources` among them, each by run; `gap_hits`
    (run, id) are those of the gaps' queries, and new where `tables["earlier"]` (run, id) lacks them, which makes a retry.
    gap_queries: (run, query, origin). gap_plans: (run, model, error, raw_response), one row a run.
    """
    counted = {name: t for name, t in tables.items() if name in COUNTED}
    seen = context.diagnostics(hits).select("run", F.col("retrieved").alias("retrieved_count"), F.col("evidence_chunks").alias("evidence_chunk_count"), F.col("weak_chunks").alias("filtered_weak_chunk_count"), F.col("primary_sources").alias("primary_source_count"))
    made = _citations(answers, tables["sources"])
    for part in (seen, _rows(counted), _gaps(gap_queries)):
        made = made.join(part, "run", "left")
    if "gap_hits" in tables and "earlier" in tables:
        new = tables["gap_hits"].select("run", "id").distinct().join(tables["earlier"].select("run", "id"), ["run", "id"], "left_anti")
        made = made.join(new.groupBy("run").agg(F.count("*").alias("gap_new_chunk_count")), "run", "left")
    said = gap_plans.select("run", T.clean(F.col("model")).alias("gap_query_model"), T.clean(F.col("error")).alias("gap_query_error"), F.substring(T.clean(F.col("raw_response")), 1, RAW_RESPONSE).alias("llm_gap_query_raw_response"))
    made = made.join(said, "run", "left")
    for name in [*COUNTED.values(), "gap_new_chunk_count"]:
        made = made if name in made.columns else made.withColumn(name, F.lit(0).cast("long"))
    numbers = [name for name in made.columns if name.endswith("_count") or name == "selected_objectives"]
    made = made.fillna(0, numbers).fillna("", ["gap_query_model", "gap_query_error", "llm_gap_query_raw_response"]).fillna("none", ["gap_query_source"])
    made = made.withColumn("gap_retry_count", (F.col("gap_new_chunk_count") > 0).cast("long"))
    return made.withColumn("similar_previous_objective_count", F.greatest(F.lit(0), F.col("selected_objectives") - 1)).drop("selected_objectives")
