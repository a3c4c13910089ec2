"""The registered queries of report review, gaps, task details and validators, and their SQL.

A conversation is a run: its report has the assistant's turns, each with a mark of its turn, under headings from every second
of the user's turns; the user's turns are its questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import terms as W
from .functions import text as T
from .operators import review
from .registry import _clean, _t, query
from .research_queries import _any, _in, _qtok

# -- SQL of the shared functions ----------------------------------------------------------------------------------------


def _bare(x: str) -> str:
    return _clean(rf"regexp_replace(regexp_replace(regexp_replace({x}, '`([^`]*)`', '\1', 'g'), '[*_#|]+', ' ', 'g'), '\[\d+\]', '', 'g')")


def _heading(x: str) -> str:
    return _clean(rf"lower(regexp_replace(regexp_replace(regexp_replace({_bare(x)}, '[‑–—]', '-', 'g'), '^\d+[.)]\s*', ''), '[^a-zA-Z0-9]+', ' ', 'g'))")


def _once(x: str) -> str:
    """Distinct members in order; x is a column's name."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _detail(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({_bare(x)}, '[A-Za-z][A-Za-z0-9_+.-]{{2,}}'), lambda t: lower(t)), lambda t: t NOT IN ({_in(W.REPORT_STOPWORDS)})))"


def _names(x: str) -> str:
    v = f"regexp_replace({_bare(x)}, '[‑–]', '-', 'g')"
    hyphened = rf"list_transform(regexp_extract_all({v}, '\b[A-Za-z][A-Za-z0-9_+.-]*(?:-[A-Za-z0-9_+.-]+)+\b'), lambda t: lower(t))"
    return f"list_concat(list_transform(regexp_extract_all({v}, '[A-Za-z][A-Za-z0-9_+.-]{{2,}}'), lambda t: lower(t)), flatten(list_transform({hyphened}, lambda t: [t, replace(t, '-', '')])))"


def _named(x: str) -> str:
    # letters with accents belong to words, which this dialect's word boundary doesn't know
    words = rf"list_filter(list_transform(regexp_extract_all(regexp_replace({_clean(x)}, '[À-ÖØ-öø-ÿŒœẞ]', '_', 'g'), '\b[A-Z][A-Za-z0-9_+.-]{{2,}}\b|\b[A-Z]{{2,}}\b'), lambda t: lower(t)), lambda t: NOT contains(t, '_') AND t NOT IN ({_in(W.REPORT_STOPWORDS)}))"
    return f"list_distinct(list_concat({words}, list_filter([{_in(W.NAMED_PHRASES)}], lambda p: contains(lower({_clean(x)}), p))))"


_PARTS = rf"""q AS (SELECT conv_id AS run, turn AS number, CASE turn % 3 WHEN 0 THEN 'What is ' WHEN 1 THEN '' ELSE 'how Evidence on ' END || {_clean("text")}[1:60] || '?' AS question FROM conversations WHERE role = 'user'),
part AS (SELECT conv_id AS run, turn, CASE WHEN role = 'user' AND turn % 4 = 0 THEN '## ' || {_clean("text")}[1:40] WHEN role = 'assistant' THEN coalesce(text, '') || ' [' || turn || ']' END AS part FROM conversations),
rep AS (SELECT run, coalesce(string_agg(part, chr(10) ORDER BY turn, part), '') || CASE run % 3 WHEN 0 THEN chr(10) || '## References' WHEN 1 THEN chr(10) || '# 1. Conclusion' || chr(10) || 'See [citation needed], as evidence is missing' ELSE '' END AS raw FROM part GROUP BY run),
rc AS (SELECT run, regexp_replace(regexp_replace(regexp_replace(raw, '[ \t]+(\n|$)', '\1', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS report FROM rep),
rd AS (SELECT run, report, {_names("report")} AS terms, list_transform(list_filter(string_split(report, chr(10)), lambda x: regexp_matches(x, '^\s{{0,3}}#{{1,6}}\s+\S')), lambda x: {_heading("regexp_extract(x, '^[ ]{{0,3}}#{{1,6}}[ ]+(.+?)[ ]*#*[ ]*$', 1)".replace("{{", "{").replace("}}", "}"))}) AS titles,
  list_sort(list_distinct(list_transform(regexp_extract_all(report, '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)))) AS cited FROM rc),
qa AS (SELECT run, number, {_clean("question")} AS question, {_names("question")} AS tn, {_named("question")} AS named FROM q),
qb AS (SELECT *, list_filter(tn, lambda t: t NOT IN ({_in(W.REPORT_STOPWORDS)})) AS ts, regexp_replace(regexp_replace(regexp_replace(question, '\?+$', ''), '(?i)^(what|how|why|when|where|which)\s+(is|are|does|do|did|can|should)\s+', ''), '(?i)^(what|how|why|when|where|which)\s+', '') AS h0 FROM qa),
qc AS (SELECT *, {_once("ts")} AS own, string_split(trim({_clean(r"regexp_replace(h0, '(?i)\b(e\.g\.|eg|examples?|evidence|results?)\b', '', 'g')")}, ' .,:;'), ' ') AS hw FROM qb),
qd AS (SELECT *, trim(array_to_string(list_transform(list_transform(list_filter(hw, lambda w: w <> ''), lambda w: trim(w, '.,:;()[]{{}}')), lambda w: CASE WHEN regexp_matches(w, '^.+\p{{Lu}}') THEN w ELSE replace(upper(w[1:1]), 'ẞ', 'Ss') || lower(w[2:]) END), ' ')[1:90]) AS h1 FROM qc),
qe AS (SELECT run, number, question, own, named, CASE WHEN h1 = '' THEN 'Research Finding' ELSE h1 END AS heading, CASE WHEN (CASE WHEN len(named) > 0 THEN len(named) ELSE least(4, len(own)) END) <= 2 THEN 1 ELSE 2 END AS enough FROM qd),
qf AS (SELECT qe.*, report, greatest(len(list_intersect(named, terms)), len(list_intersect(own[1:6], terms))) >= enough AS covered, {_heading("heading")} AS wanted, titles FROM qe JOIN rd ON rd.run = qe.run),
cov AS (SELECT *, {_detail("wanted")} AS wd FROM qf),
met AS (SELECT run, number, question, heading, covered, wanted = '' OR len(list_filter(titles, lambda t: contains(wanted, t) OR contains(t, wanted) OR (len(wd) > 0 AND len(list_intersect(wd, {_detail("t")})) >= least(3, greatest(least(2, len(wd)), len(wd) // 3))))) > 0 AS placed FROM cov)"""


def _questions(spark, sf_dir) -> DataFrame:
    lead = F.when(F.col("turn") % 3 == 0, "What is ").when(F.col("turn") % 3 == 1, "").otherwise("how Evidence on ")
    return _t(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("run"), F.col("turn").alias("number"), F.concat(lead, F.substring(T.clean(F.col("text")), 1, 60), F.lit("?")).alias("question"))


def _reports(spark, sf_dir) -> DataFrame:
    part = F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), F.concat(F.lit("## "), F.substring(T.clean(F.col("text")), 1, 40))).when(F.col("role") == "assistant", F.concat(T.text(F.col("text")), F.lit(" ["), F.col("turn").cast("string"), F.lit("]")))
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.struct("turn", part.alias("part")).alias("p"))
    made = rows.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p.part").isNotNull(), F.col("p")))), lambda x: x["part"]), "\n").alias("report"))
    end = F.when(F.col("run") % 3 == 0, "\n## References").when(F.col("run") % 3 == 1, "\n# 1. Conclusion\nSee [citation needed], as evidence is missing").otherwise("")
    return made.select("run", F.concat("report", end).alias("report"))


def _sources(spark, sf_dir) -> DataFrame:
    runs = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run")).distinct().filter("run % 4 <> 3")
    return runs.select("run", F.explode(F.array(F.lit(1), F.lit(3))).alias("index")).withColumn("url", F.concat(F.lit("http://s.example/"), F.col("index").cast("string")))


@query(f"WITH {_PARTS} SELECT run, number, heading, covered, placed FROM met")
def question_coverage(spark, sf_dir):
    return review.coverage(review.read(_reports(spark, sf_dir)), _questions(spark, sf_dir)).select("run", "number", "heading", "covered", "placed")


def _has(*names: str) -> str:
    return f"len(list_intersect(titles, [{_in(names)}])) > 0"


_SECTIONS = ", ".join(f"CASE WHEN NOT {_has(*names)} THEN 'missing schema section: {label}' END" for label, names in review.SECTIONS)


@query(rf"""WITH {_PARTS}, ra AS (SELECT *, list_filter(cited, lambda i: run % 4 <> 3 AND i NOT IN (1, 3)) AS away FROM rd),
own AS (SELECT run, 0 AS part, list_filter(list_transform(CASE WHEN report = '' THEN ['report is empty', {_SECTIONS}] ELSE [CASE WHEN run % 3 <> 0 THEN 'report must include a References section' END,
  CASE WHEN run % 3 = 1 THEN 'report contains placeholder or non-source citation markers' END, CASE WHEN len(away) > 0 THEN 'report uses unavailable citations: ' || array_to_string(list_transform(away, lambda i: '[' || i || ']'), ', ') END,
  {_SECTIONS}] END, lambda x: x), lambda x: x IS NOT NULL) AS found FROM ra),
each AS (SELECT run, 0 AS part, unnest(range(len(found))) AS number, unnest(found) AS issue FROM own
  UNION ALL SELECT run, 1, number, 'missing planner topic section: ' || heading FROM met WHERE NOT placed UNION ALL SELECT run, 2, number, 'missing planner topic: ' || question FROM met WHERE NOT covered)
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY part, number, issue) AS INTEGER) AS place, issue FROM each""")
def report_issues(spark, sf_dir):
    return review.issues(_reports(spark, sf_dir), _questions(spark, sf_dir), _sources(spark, sf_dir))


@query(rf"""WITH {_PARTS}, n AS (SELECT run, CASE WHEN {_any(f"lower({_clean('report')})", review.GAP_NOTES)} THEN lower({_bare("report")}[1:300]) ELSE '' END AS notes FROM rc),
r AS (SELECT cov.run, number, question, CASE WHEN number % 6 = 0 THEN 0 WHEN NOT covered THEN 1 WHEN len(list_filter({_detail("question")}, lambda t: contains(notes, t))) > 0 THEN 2 END AS r FROM cov JOIN n ON n.run = cov.run)
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY r, number) AS INTEGER) AS place, number, ['status', 'terms', 'notes'][r + 1] AS reason, {_clean(f"'Goal  of ' || run || ' ' || question || ' {review.ASK}'")}[1:700] AS query FROM r WHERE r IS NOT NULL""")
def report_gaps(spark, sf_dir):
    asked = _questions(spark, sf_dir)
    statuses = asked.select("run", "number", F.when(F.col("number") % 6 == 0, "Partially covered").otherwise("covered").alias("status"))
    answers = _reports(spark, sf_dir)
    open_ = review.gaps(answers.withColumnRenamed("report", "synthesis"), asked, statuses)
    queries = review.gap_queries(open_, answers.select("run", F.concat(F.lit("Goal  of "), F.col("run").cast("string")).alias("objective")))
    return open_.join(queries.select("run", "place", "query"), ["run", "place"]).select("run", "place", "number", "reason", "query")


def report_figures(spark, sf_dir):
    """Figures of documents that a shorter evidence lacks: words are made figures, as no table has results."""
    told = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"tion\. ", "tion. Accuracy 91.5 % in 2021, v1.2-3 and top-1 "), "the ", "the 7.5 ")
    rows = _t(spark, sf_dir, "documents").select("doc_id", told.alias("report"), F.substring(told, 1, 400).alias("evidence"))
    return rows.select("doc_id", F.array_join(review.unsupported(F.col("report"), F.col("evidence")), " ").alias("figures"))


query()(report_figures)


@query(rf"""WITH q AS (SELECT conv_id AS run, turn AS number, {_clean("text")}[1:60] AS question FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id AS run, turn AS position, CASE WHEN turn % 3 = 0 THEN upper({_clean("text")}[1:60]) ELSE {_clean("text")}[1:45] END AS context, 'goal ' || turn || ' ' || {_clean("text[1:10]")} || ' http://s.example/' || turn AS d FROM conversations),
m AS (SELECT q.run, number, position, question, {_clean("context")} AS context, {_qtok("question")} AS qt, {_qtok("context")} AS ct, d FROM q JOIN t ON t.run = q.run)
SELECT run, number, {_clean("string_agg(d, ' ' ORDER BY position, d)")} AS details FROM m WHERE len(ct) > 0 AND (lower(context) = lower({_clean("question")}) OR len(list_intersect(qt, ct)) / greatest(1, least(len(qt), len(ct))) >= 0.45) GROUP BY run, number""")
def task_details(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), "turn", "role", T.clean(F.col("text")).alias("c"), F.col("text"))
    # upper case character by character: none becomes two, and a sharp s has a capital of its own
    upper = lambda c: F.array_join(F.transform(F.split(F.replace(c, F.lit("ß"), F.lit("ẞ")), ""), lambda x: F.when(F.length(F.upper(x)) > 1, x).otherwise(F.upper(x))), "")
    context = F.when(F.col("turn") % 3 == 0, upper(F.substring("c", 1, 60))).otherwise(F.substring("c", 1, 45))
    n = F.col("turn").cast("string")
    tasks = turns.select("run", F.col("turn").alias("position"), context.alias("query_context"), F.concat(F.lit("goal "), n).alias("extraction_goal"), F.array(F.substring("text", 1, 10), F.lit(None), F.lit("")).alias("expected_signals"), F.concat(F.lit("http://s.example/"), n).alias("url"))
    return review.task_details(turns.filter("role = 'user'").select("run", F.col("turn").alias("number"), F.substring("c", 1, 60).alias("question")), tasks)


_LACKS = ", ".join(f"CASE WHEN {_clean(f)} = '' THEN '{f} is required' END" for f in review.TASK_FIELDS)


@query(rf"""WITH p AS (SELECT conv_id AS run, CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE 'Goal ' || conv_id END AS objective, CASE WHEN conv_id % 5 = 1 THEN 'other' WHEN conv_id % 5 > 1 THEN 'goal  ' || conv_id END AS asked, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE count(*) FILTER (role = 'user') END AS n FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id AS run, turn AS position, text AS query_context, CASE WHEN turn % 4 = 1 THEN '' ELSE 'u' END AS url, CASE WHEN conv_id % 2 = 1 THEN 'rag' END AS source_type, 'goal' AS extraction_goal FROM conversations WHERE role = 'assistant' AND conv_id % 4 <> 1),
a AS (SELECT run, 0 AS part, [CASE WHEN {_clean("objective")} = '' THEN 'research_plan.objective is required' END, CASE WHEN {_clean("asked")} <> '' AND lower({_clean("objective")}) <> lower({_clean("asked")}) THEN 'research_plan.objective does not match requested objective' END,
  CASE WHEN n = 0 THEN 'research_plan.sub_questions is required' END, CASE WHEN run NOT IN (SELECT run FROM t) THEN 'research_plan.tasks is required' END] AS found FROM p
  UNION ALL SELECT run, position, list_transform([{_LACKS}], lambda x: 'task ' || position || '.' || x) FROM t),
e AS (SELECT run, part, unnest(range(len(found))) AS k, unnest(found) AS problem FROM a)
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY part, k) AS INTEGER) AS place, 'planner_node ' || problem AS problem FROM e WHERE problem IS NOT NULL""")
def plan_problems(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "run")
    n = F.col("run").cast("string")
    plans = turns.groupBy("run").agg(F.collect_list(F.when(F.col("role") == "user", F.col("text"))).alias("s")).select(
        "run", F.when(F.col("run") % 3 == 0, " ").otherwise(F.concat(F.lit("Goal "), n)).alias("objective"),
        F.when(F.col("run") % 5 == 1, "other").when(F.col("run") % 5 > 1, F.concat(F.lit("goal  "), n)).alias("asked"), F.when(F.col("run") % 7 != 0, F.col("s")).alias("sub_questions"),
    )
    tasks = turns.filter("role = 'assistant' AND run % 4 <> 1").select(
        "run", F.col("turn").alias("position"), F.col("text").alias("query_context"), F.when(F.col("turn") % 4 == 1, "").otherwise("u").alias("url"), F.when(F.col("run") % 2 == 1, "rag").alias("source_type"), F.lit("goal").alias("extraction_goal"),
    )
    return review.plan_problems(plans, tasks)
