"""A report's refresh and a run's counters on small tables."""

from pyspark.sql import functions as F

from sievewright.operators import refresh


def test_gap_tasks_and_plans(spark):
    missing = spark.createDataFrame([(1, 2, "b  two"), (1, 1, "a"), (1, 3, " "), (1, 4, "c"), (2, 1, None)], "run int, place int, question string")
    queries = spark.createDataFrame([(1, 1, ""), (1, 2, "find a"), (1, 5, " find b "), (3, 1, "stray")], "run int, place int, query string")
    tasks = refresh.gap_tasks(missing, queries)
    rows = [tuple(r) for r in tasks.orderBy("run", "position").select("run", "position", "query_context", "url", "extraction_goal").collect()]
    assert rows == [(1, 1, "a", "find a", refresh.GOAL + "a"), (1, 2, "b two", "find b", refresh.GOAL + "b two"), (1, 3, "c", "c", refresh.GOAL + "c")]
    plans = spark.createDataFrame([(1, " goal "), (2, "kept")], "run int, objective string")
    (plan,) = refresh.gap_plans(plans, tasks).collect()
    assert (plan.run, plan.objective, plan.sub_questions) == (1, "goal", ["a", "b two", "c"])


def _tables(spark, answers, sources, chunks, coverage):
    return {
        "answers": spark.createDataFrame(answers, "run int, synthesis string"), "sources": spark.createDataFrame(sources, "run int, position int, index int, url string"),
        "chunks": spark.createDataFrame(chunks, "run int, position int, id string, source_index int"), "coverage": spark.createDataFrame(coverage, "run int, position int, question string, status string, source_indexes array<int>"),
    }


def test_merge(spark):
    old = _tables(
        spark, [(1, "Old [1] text"), (2, "kept  as is"), (3, None)], [(1, 1, 1, "http://A"), (1, 2, 4, ""), (2, 1, None, "u")], [(1, 1, "c1", 1), (2, 1, "c2", None)],
        [(1, 1, "What is x?", "missing", [1]), (1, 2, "??", "missing", None), (1, 3, "y", "covered", [4]), (2, 1, "what is x", "partial", [])],
    )
    # a known address, a new one twice, two without an address; the second has no number and gets its position's
    new = _tables(
        spark, [(1, "New [1] [2] [3] [4] [5] [9]"), (3, "fresh [1]")], [(1, 1, 1, "HTTP://a "), (1, 2, None, "http://b"), (1, 3, 3, "http://B"), (1, 4, 4, ""), (1, 5, 5, None)], [(1, 1, "n1", 2), (1, 2, "n2", 9), (1, 3, "n3", None)],
        [(1, 1, "z", "covered", [5]), (1, 2, "WHAT is: x", "partial", [1]), (1, 3, "what is x", "covered", [2, 9]), (1, 4, "!", "covered", [1])],
    )
    made = refresh.merge(old, new)
    got = {r.run: (r.synthesis, r.refreshed) for r in made["answers"].collect()}
    assert got == {1: ("Old [1] text " + refresh.HEADING + " New [1] [5] [5] [6] [7] [9]", True), 2: ("kept  as is", False), 3: (refresh.HEADING + " fresh [1]", True)}
    assert sorted((r["run"], r["index"], r["url"] or "", r["added"]) for r in made["sources"].collect()) == [(1, 1, "http://A", False), (1, 4, "", False), (1, 5, "http://b", True), (1, 6, "", True), (1, 7, "", True), (2, 1, "u", False)]
    assert sorted((r.run, r.added, r.position, r.id, r.source_index) for r in made["chunks"].collect()) == [(1, False, 1, "c1", 1), (1, True, 1, "n1", 5), (1, True, 2, "n2", 9), (1, True, 3, "n3", None), (2, False, 1, "c2", None)]
    rows = sorted((r.run, r.appended, r.position, r.question, r.status, r.source_indexes) for r in made["coverage"].collect())
    assert rows == [(1, False, 1, "what is x", "covered", [5, 9]), (1, False, 2, "??", "missing", None), (1, False, 3, "y", "covered", [4]), (1, True, 1, "z", "covered", [7]), (2, False, 1, "what is x", "partial", [])]


def test_merge_without_refresh(spark):
    old = _tables(spark, [(1, "a [1]")], [(1, 1, 1, "u")], [(1, 1, "c", 1)], [(1, 1, "q", "covered", [1])])
    empty = {name: df.filter("false") for name, df in old.items()}
    made = refresh.merge(old, empty)
    assert [tuple(r) for r in made["answers"].collect()] == [(1, "a [1]", False)]
    assert [made[n].count() for n in ("sources", "chunks", "coverage")] == [1, 1, 1]
    made = refresh.merge(empty, old)
    assert [made[n].count() for n in ("answers", "sources", "chunks", "coverage")] == [0, 1, 1, 1]


def test_counters(spark):
    long_ = "evidence of many words that says what was found in each of the trials and by whom it was read and " * 3
    hits = spark.createDataFrame([(1, 1, "a", long_, "t", "http://x.edu/1", "web", "", "", 1.0), (1, 2, "b", "short", "", "", None, None, None, 0.0)], "run int, position int, id string, document string, title string, url string, source_type string, contexts string, parent_id string, score double")
    answers = spark.createDataFrame([(1, "said 【1】 and [2, 7] [1]"), (2, None)], "run int, synthesis string")
    sources = spark.createDataFrame([(1, 1), (1, 2), (1, None)], "run int, index int")
    tables = {"sources": sources, "gap_hits": hits.select("run", "id").unionByName(hits.select("run", F.lit("c").alias("id"))), "earlier": hits.select("run", "id"), "scopes": sources}
    queries = spark.createDataFrame([(1, "Q one", "llm"), (1, "q  one", "fallback"), (1, "q two", "fallback")], "run int, query string, origin string")
    plans = spark.createDataFrame([(1, " m ", None, "x" * 3_000)], "run int, model string, error string, raw_response string")
    made = {r.run: r.asDict() for r in refresh.counters(answers, hits, tables, queries, plans).collect()}
    assert made[1] == {
        "run": 1, "retrieved_count": 2, "evidence_chunk_count": 1, "filtered_weak_chunk_count": 1, "primary_source_count": 1, "source_count": 3, "supporting_chunk_count": 0, "invalid_citation_count": 1, "cited_source_count": 2,
        "source_coverage_count": 0, "browser_signal_count": 0, "gap_retrieval_query_count": 2, "gap_query_model": "m", "gap_query_source": "mixed", "llm_gap_query_count": 1, "fallback_gap_query_count": 2, "gap_query_error": "",
        "llm_gap_query_raw_response": "x" * 1_000, "gap_retrieved_count": 4, "gap_new_chunk_count": 1, "gap_retry_count": 1, "allowed_history_key_count": 0, "similar_previous_objective_count": 2,
    }
    assert made[2] == {k: 2 if k == "run" else "none" if k == "gap_query_source" else 0 if isinstance(v, int) else "" for k, v in made[1].items()}
