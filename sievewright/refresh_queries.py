"""The registered queries of a report's refresh and of a run's counters, and their SQL.

A benchmark item is a run; the best documents for its words are its hits. The first hits are a report's sources, later ones
(some of them the same) those of its refresh.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import context, refresh, reports
from .registry import _clean, _t, query
from .research_queries import _CONTEXT, _context, _good, _qtok

_PLAIN = "translate(coalesce(text, ''), '[]', '()')"

_STATUS = rf"""
l AS (SELECT *, strpos(lower(syn), lower(q)) AS loc, {_qtok('q')} AS qt FROM s),
c AS (SELECT *, CASE WHEN q = '' THEN '' WHEN loc > 0 THEN substr(syn, loc, length(q)) || regexp_extract(substr(syn, loc + length(q)) || chr(10) || '## What', '(?is)^(.*?)\n\s*(?:#{{1,6}}\s+|\d+\.\s+|[-*]\s+)?(?:What|How|Why|Which|When|Where)\b', 1)
  ELSE array_to_string(list_filter(string_split(syn, chr(10)), lambda x: len(list_intersect(qt, {_qtok('x')})) >= greatest(2, least(4, len(qt)))), chr(10)) END AS sec FROM l),
z AS (SELECT *, lower({_clean('sec')}) AS low FROM c),
cov AS (SELECT run, number, q, CASE WHEN low = '' OR regexp_matches(low, '{reports.MISSING}') THEN 'missing' WHEN regexp_matches(low, '{reports.WEAK}') THEN 'partial'
  WHEN regexp_matches(low, '{reports.COVERED}') OR regexp_matches(sec, '\[\d+\]') THEN 'covered' ELSE 'partial' END AS status FROM z)"""


@query(rf"""{_CONTEXT},
a AS (SELECT item_id AS run, {_PLAIN} AS text FROM benchmark), r AS (SELECT run, text, text[1:45] || ' [1] [2]' || chr(10) || '## What next [3]' AS syn FROM a),
s AS (SELECT run, 1 AS number, {_clean("text[1:20]")} AS q, syn FROM r UNION ALL SELECT run, 2, {_clean("text[25:44]")}, syn FROM r UNION ALL SELECT run, 3, 'zzz ' || {_clean("text[50:79]")}, syn FROM r),
{_STATUS},
task AS (SELECT run, number, q, row_number() OVER (PARTITION BY run ORDER BY number) AS position FROM cov WHERE status <> 'covered' AND q <> ''),
gone AS (SELECT DISTINCT run FROM task),
os AS (SELECT run, position AS index, url FROM o WHERE position <= 5), top AS (SELECT run, max(index) AS top FROM os GROUP BY run),
known AS (SELECT run, lower(url) AS k, max(index) AS known FROM os WHERE url <> '' GROUP BY run, lower(url)),
rs AS (SELECT o.run, o.id, o.position - 3 AS old, url, lower(url) AS k FROM o JOIN gone ON gone.run = o.run WHERE o.position BETWEEN 4 AND 10),
fs AS (SELECT rs.*, known, top, known IS NULL AND (rs.k = '' OR row_number() OVER (PARTITION BY rs.run, rs.k ORDER BY old) = 1) AS added FROM rs LEFT JOIN known ON known.run = rs.run AND known.k = rs.k LEFT JOIN top ON top.run = rs.run),
nu AS (SELECT *, CASE WHEN added THEN coalesce(top, 0) + sum(CAST(added AS INTEGER)) OVER (PARTITION BY run ORDER BY old) END AS new FROM fs),
mp AS (SELECT *, coalesce(known, max(new) OVER (PARTITION BY run, CASE WHEN k = '' THEN '#' || old ELSE k END)) AS index FROM nu),
src AS (SELECT run, string_agg(index || '=' || url, ' ' ORDER BY index, url) AS sources FROM (SELECT run, index, url FROM os UNION ALL SELECT run, index, url FROM mp WHERE added) GROUP BY run),
tk AS (SELECT task.*, coalesce(mp.index, task.position) AS mark, q || ' ' || CASE WHEN task.run % 2 = 0 AND task.position = 1 THEN 'evidence for ' || task.run ELSE q END AS told FROM task LEFT JOIN mp ON mp.run = task.run AND mp.old = task.position),
seven AS (SELECT gone.run, coalesce(index, 7) AS seven FROM gone LEFT JOIN mp ON mp.run = gone.run AND old = 7),
rf AS (SELECT tk.run, string_agg(told || ' [' || mark || ']', ' ' ORDER BY position) || ' [' || any_value(seven) || '] [40]' AS fresh FROM tk JOIN seven ON seven.run = tk.run GROUP BY tk.run),
ke AS (SELECT *, trim(regexp_replace(lower({_clean("q")}), '[^a-z0-9]+', ' ', 'g')) AS k FROM cov),
kn AS (SELECT tk.run, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS k, max_by({{'q': '? ' || q || '!', 'm': mark}}, position) AS item FROM tk GROUP BY ALL),
cv AS (SELECT ke.run, string_agg(CASE WHEN item IS NULL OR ke.k = '' THEN q || ':' || status || ':1' ELSE item.q || ':covered:' || item.m || ',40' END, ' | ' ORDER BY number) AS coverage FROM ke LEFT JOIN kn ON kn.run = ke.run AND kn.k = ke.k GROUP BY ke.run),
ch AS (SELECT run, string_agg(id || '>' || i, ' ' ORDER BY part, position) AS chunks FROM (SELECT run, 0 AS part, position, id, position AS i FROM o WHERE position <= 3 UNION ALL SELECT run, 1, old, id, index FROM mp WHERE old <= 3) GROUP BY run)
SELECT r.run AS item_id, fresh IS NOT NULL AS refreshed, sha256(CASE WHEN fresh IS NULL THEN syn ELSE {_clean(f"{_clean('syn')} || ' {refresh.HEADING} ' || fresh")} END) AS synthesis_hash, coalesce(sources, '') AS sources, coverage, coalesce(chunks, '') AS chunks
FROM r LEFT JOIN rf ON rf.run = r.run LEFT JOIN src ON src.run = r.run LEFT JOIN cv ON cv.run = r.run LEFT JOIN ch ON ch.run = r.run""")
def report_refresh(spark, sf_dir):
    """Reports on benchmark items, checked for what they don't cover, and merged with a refresh for just that."""
    hits = _context(spark, sf_dir).select("run", "position", "id", "url")
    runs = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run"), F.translate(F.coalesce("text", F.lit("")), "[]", "()").alias("text"))
    answers = runs.select("run", F.concat(F.substring("text", 1, 45), F.lit(" [1] [2]\n## What next [3]")).alias("synthesis"))
    asked = [F.struct(F.lit(n).alias("number"), q.alias("question")) for n, q in enumerate((T.clean(F.substring("text", 1, 20)), T.clean(F.substring("text", 25, 20)), F.concat(F.lit("zzz "), T.clean(F.substring("text", 50, 30)))), 1)]
    questions = runs.select("run", F.inline(F.array(*asked)))
    stated = context.coverage(questions.join(answers, "run").withColumn("indexes", F.lit([1, 2, 3]))).select("run", "number", "status").join(questions, ["run", "number"])
    covered = stated.select("run", F.col("number").alias("position"), "question", "status", F.array(F.lit(1)).alias("source_indexes"))
    missing = covered.filter("status <> 'covered'").select("run", F.col("position").alias("place"), "question")
    found = runs.filter("run % 2 = 0").select("run", F.lit(1).alias("place"), F.concat(F.lit("evidence for "), F.col("run").cast("string")).alias("query"))
    tasks = refresh.gap_tasks(missing, found)

    old = {"answers": answers, "coverage": covered, "sources": hits.filter("position <= 5").withColumn("index", F.col("position")), "chunks": hits.filter("position <= 3").withColumn("source_index", F.col("position"))}
    later = hits.filter("position BETWEEN 4 AND 10").join(tasks.select("run").distinct(), "run", "left_semi").withColumn("position", F.col("position") - 3)
    told = F.concat("query_context", F.lit(" "), "url", F.lit(" ["), F.col("position").cast("string"), F.lit("]"))
    written = tasks.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("position", told.alias("told")))).alias("t"))
    new = {
        "answers": written.select("run", F.concat(F.array_join(F.transform("t", lambda x: x["told"]), " "), F.lit(" [7] [40]")).alias("synthesis")), "sources": later.withColumn("index", F.lit(None).cast("int")),
        "coverage": tasks.select("run", "position", F.concat(F.lit("? "), "query_context", F.lit("!")).alias("question"), F.lit("covered").alias("status"), F.array(F.col("position"), F.lit(40)).alias("source_indexes")),
        "chunks": later.filter("position <= 3").withColumn("source_index", F.col("position")),
    }
    made = refresh.merge(old, new)

    def line(df, name, order, shown, mark):
        rows = df.select("run", F.struct(*order, shown.alias("shown")).alias("x")).groupBy("run").agg(F.array_sort(F.collect_list("x")).alias("x"))
        return rows.select("run", F.array_join(F.transform("x", lambda x: x["shown"]), mark).alias(name))

    text = lambda c: F.col(c).cast("string")
    out = made["answers"].select("run", "refreshed", F.sha2("synthesis", 256).alias("synthesis_hash"))
    out = out.join(line(made["sources"], "sources", ["index", "url"], F.concat(text("index"), F.lit("="), "url"), " "), "run", "left")
    out = out.join(line(made["coverage"], "coverage", ["appended", "position"], F.concat("question", F.lit(":"), "status", F.lit(":"), F.array_join(F.col("source_indexes").cast("array<string>"), ",")), " | "), "run", "left")
    out = out.join(line(made["chunks"], "chunks", ["added", "position"], F.concat(text("id"), F.lit(">"), text("source_index")), " "), "run", "left")
    return out.fillna("", ["sources", "chunks"]).withColumnRenamed("run", "item_id")


@query(rf"""{_CONTEXT},
a AS (SELECT item_id AS run, {_PLAIN} AS text FROM benchmark),
d AS (SELECT *, {_good("trim(substr(flat, 1, 360))")} AS good FROM o),
n AS (SELECT run, count(*) AS retrieved_count, count(*) FILTER (good) AS evidence_chunk_count, count(*) FILTER (NOT good) AS filtered_weak_chunk_count, count(*) FILTER (pr = 0) AS primary_source_count, count(*) FILTER (position <= 6) AS source_count,
  count(*) FILTER (position <= 4) AS supporting_chunk_count, count(*) FILTER (id % 4 = 0) AS source_coverage_count, count(*) FILTER (id % 7 = 0) AS browser_signal_count, count(*) FILTER (position > 5) AS gap_retrieved_count, count(*) FILTER (position > 8) AS gap_new_chunk_count,
  count(DISTINCT source) AS keys, count(DISTINCT lang) AS scopes FROM d GROUP BY run),
i AS (SELECT a.run, list_distinct([a.run % 9, 3, 9, 40]) AS cited, coalesce(source_count, 0) AS k FROM a LEFT JOIN n ON n.run = a.run)
SELECT a.run AS item_id, coalesce(retrieved_count, 0) AS retrieved_count, coalesce(evidence_chunk_count, 0) AS evidence_chunk_count, coalesce(filtered_weak_chunk_count, 0) AS filtered_weak_chunk_count, k AS source_count, coalesce(supporting_chunk_count, 0) AS supporting_chunk_count,
  coalesce(primary_source_count, 0) AS primary_source_count, CAST(len(list_filter(cited, lambda x: x < 1 OR x > k)) AS INTEGER) AS invalid_citation_count, CAST(len(list_filter(cited, lambda x: x BETWEEN 1 AND k)) AS INTEGER) AS cited_source_count,
  coalesce(source_coverage_count, 0) AS source_coverage_count, coalesce(browser_signal_count, 0) AS browser_signal_count, CASE a.run % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS gap_retrieval_query_count, CASE a.run % 4 WHEN 1 THEN 'model-a' ELSE '' END AS gap_query_model,
  ['none', 'llm', 'fallback', 'mixed'][a.run % 4 + 1] AS gap_query_source, CASE WHEN a.run % 4 IN (1, 3) THEN 1 ELSE 0 END AS llm_gap_query_count, CASE WHEN a.run % 4 IN (2, 3) THEN 1 ELSE 0 END AS fallback_gap_query_count,
  CASE a.run % 4 WHEN 1 THEN 'no answer' ELSE '' END AS gap_query_error, CASE a.run % 4 WHEN 1 THEN {_clean("text")}[1:1000] ELSE '' END AS llm_gap_query_raw_response, coalesce(gap_retrieved_count, 0) AS gap_retrieved_count, coalesce(gap_new_chunk_count, 0) AS gap_new_chunk_count,
  CASE WHEN gap_new_chunk_count > 0 THEN 1 ELSE 0 END AS gap_retry_count, coalesce(keys, 0) AS allowed_history_key_count, greatest(0, coalesce(scopes, 0) - 1) AS similar_previous_objective_count
FROM a LEFT JOIN n ON n.run = a.run JOIN i ON i.run = a.run""")
def answer_counters(spark, sf_dir):
    """All counters of the answers to benchmark items, from their hits and the words of their texts."""
    hits = _context(spark, sf_dir)
    kinds = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("key"), F.coalesce("lang", F.lit("")).alias("scope"))
    named = hits.select("run", "id").join(kinds, "id")
    runs = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run"), F.translate(F.coalesce("text", F.lit("")), "[]", "()").alias("text"))
    answers = runs.select("run", F.concat("text", F.lit(" ["), (F.col("run") % 9).cast("string"), F.lit("] [3, 9] [ 40 ]")).alias("synthesis"))
    tables = {
        "sources": hits.filter("position <= 6").select("run", F.col("position").alias("index")), "supporting": hits.filter("position <= 4"), "coverage_hits": hits.filter("id % 4 = 0"), "signals": hits.filter("id % 7 = 0"),
        "gap_hits": hits.filter("position > 5"), "earlier": hits.filter("position <= 8"), "history_keys": named.select("run", "key").distinct(), "scopes": named.select("run", "scope").distinct(),
    }
    first = runs.filter("run % 4 IN (1, 3)").select("run", F.lit("exact text").alias("query"), F.lit("llm").alias("origin"))
    second = runs.filter("run % 4 IN (2, 3)").select("run", F.lit("other text").alias("query"), F.lit("fallback").alias("origin"))
    plans = runs.filter("run % 4 = 1").select("run", F.lit("model-a").alias("model"), F.lit(" no  answer").alias("error"), F.col("text").alias("raw_response"))
    return refresh.counters(answers, hits, tables, first.unionByName(second), plans).withColumnRenamed("run", "item_id")
