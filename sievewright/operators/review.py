"""Review of reports: questions and sections they lack, claims beyond their evidence, and what is therefore asked again.

Everything is rows: reports (run, report), questions (run, number, question), sources (run, index, url). A report's terms
and headings are found once, and a question meets its own run's report alone, by an equi-join on run. Rules are tables of
(condition, message), so that what breaks them comes out as rows.

Defined cases: a null report is empty; a null or blank question is none; a run without sources has no unavailable ones;
without evidence no figure counts as unsupported; questions of runs without a report are missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions import text as T
from . import reports

# Sections of a report and the headings that stand for them, in normal form.
SECTIONS = (
    ("executive summary", ("executive summary",)),
    ("introduction/context", ("introduction and context", "introduction", "context")),
    ("cross-cutting analysis/synthesis", ("cross cutting analysis and synthesis", "cross source synthesis", "cross cutting analysis")),
    ("limitations/open questions", ("limitations and open questions", "limitations", "open questions")),
    ("conclusion", ("conclusion",)),
    ("references", ("references", "sources")),
)
REFERENCES = ("references", "reference", "sources")
#: What a question's heading leaves out.
HEADING_DROPS = (
    r"(?i)^(what|how|why|when|where|which)\s+(is|are|does|do|did|can|should)\s+", r"(?i)^(what|how|why|when|where|which)\s+", r"(?iU)\b(e\.g\.|eg|examples?|evidence|results?)\b",
)
NO_HEADING, HEADING = "Research Finding", 90
#: Patterns of placeholders and of lines with figures; what tells of a gap.
PLACEHOLDER = r"(?i)\[\s*(?:[—-]|uncited|citation needed|source needed)[^\]]*\]"
FIGURES = r"(?U)\b(benchmark|bleu|glue|imagenet|accuracy|top[- ]?[15]|f1|auc|rouge)\b|%"
GAP_STATUS = ("missing", "partial", "weak", "insufficient", "unsupported", "failed", "error")
GAP_NOTES = ("missing", "not present", "not in the retrieved", "gap")
GAP_PHRASES = ("missing evidence", "not present in the retrieved", "not present in the cited", "not quoted in the retrieved", "no explicit", "no concrete")
TABLE_HEADS = ("requirement", "planner sub-question", "source", "status")
NOTE, QUERY, LISTED = 300, 700, 5
ASK = "source-backed evidence details examples equations benchmarks limitations"
MATCHED = 0.45


def has_any(c: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


# -- headings -----------------------------------------------------------------------------------------------------------


def normal_heading(c: Column) -> Column:
    """A heading's letters and digits in lower case, without marks and its number."""
    bare = F.regexp_replace(F.regexp_replace(W.without_marks(c), "[‑–—]", "-"), r"^\d+[.)]\s*", "")
    return T.clean(F.lower(F.regexp_replace(bare, "[^a-zA-Z0-9]+", " ")))


def is_references(line: Column) -> Column:
    return normal_heading(F.regexp_replace(line, "^#+", "")).isin(*REFERENCES)


def titles(report: Column) -> Column:
    """The normal headings of a cleaned report, without those inside fences; an open fence reaches to the end."""
    bare = F.regexp_replace(report, r"(?dms)^[ \t]*```[^\n]*(?:\n.*?^[ \t]*```[^\n]*$|.*\z)", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?dm)^[ \t]{0,3}#{1,6}[ \t]+([^\n]+?)[ \t]*#*[ \t]*$"), F.lit(1))
    return F.array_distinct(F.transform(found, normal_heading))


def question_heading(question: Column) -> Column:
    """The heading under which a question is answered."""
    text = F.regexp_replace(T.clean(question), r"\?+$", "")
    for pattern in HEADING_DROPS:
        text = F.regexp_replace(text, pattern, "")
    words = F.split(F.regexp_replace(T.clean(text), r"^[ .,:;]+|[ .,:;]+$", ""), " ")

    def cased(word: Column) -> Column:
        bare = F.regexp_replace(word, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")
        first = F.upper(F.substring(bare, 1, 1))  # of some letters two, the second of which is small
        return F.when(bare.rlike(r"^.+\p{Lu}"), bare).otherwise(F.concat(F.substring(first, 1, 1), F.lower(F.concat(F.substr(first, F.lit(2)), F.substr(bare, F.lit(2))))))

    made = F.trim(F.substring(F.array_join(F.transform(F.filter(words, lambda w: w != ""), cased), " "), 1, HEADING))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(NO_HEADING))


def alike(wanted: Column, found: Column) -> Column:
    """Whether two normal headings are the same: one holds the other, or they share enough of the wanted one's terms (all of two, two of up to eight, else three)."""

    def terms_meet(mine: Column) -> Column:
        n = F.size(mine)
        enough = F.least(F.lit(3), F.greatest(F.least(F.lit(2), n), F.floor(n / 3).cast("int")))
        return (n > 0) & (F.size(F.array_intersect(mine, W.detail_terms(found))) >= enough)

    return F.contains(wanted, found) | F.contains(found, wanted) | terms_meet(W.detail_terms(wanted))


# -- what a report covers -----------------------------------------------------------------------------------------------


def read(df: DataFrame) -> DataFrame:
    """(run, report, titles, terms, cited) of reports: cleaned, with all that the rules look at, computed once."""
    rows = df.select("run", reports.clean_markdown(F.col("report")).alias("report"), T.text(F.col("report")).alias("__raw"))
    cited = F.array_distinct(T.citations(F.col("__raw")))
    return rows.select("run", "report", titles(F.col("report")).alias("titles"), W.technical_terms(F.col("report")).alias("terms"), cited.alias("cited"))


def covers(terms: Column, question: Column) -> Column:
    """Whether a report's terms answer a question: as many of its names, or of its first six terms, as needed: one of up to two that matter, else two."""
    own, named = W.without(W.technical_terms(question), W.REPORT_STOPWORDS), W.named_terms(question)
    weight = F.when(F.size(named) > 0, F.size(named)).otherwise(F.least(F.lit(4), F.size(own)))
    met = F.greatest(F.size(F.array_intersect(named, terms)), F.size(F.array_intersect(F.slice(own, 1, 6), terms)))
    return met >= F.when(weight <= 2, 1).otherwise(2)


def coverage(read_: DataFrame, questions: DataFrame) -> DataFrame:
    """(run, number, question, heading, covered, placed): whether the report answers each question, and has a heading for it."""
    asked = questions.select("run", "number", T.clean(F.col("question")).alias("question")).filter("question <> ''").withColumn("heading", question_heading(F.col("question")))
    rows = asked.join(read_.select("run", "titles", "terms"), "run", "left")
    none = F.array().cast("array<string>")
    wanted = normal_heading(F.col("heading"))
    placed = F.exists(F.coalesce("titles", none), lambda t: alike(wanted, t))
    return rows.select("run", "number", "question", "heading", covers(F.coalesce("terms", none), F.col("question")).alias("covered"), ((wanted == "") | placed).alias("placed"))


def figures(report: Column) -> Column:
    """Figures in a report's lines on results, in order: years, and numbers that are part of a name, version or range, aren't among them."""

    def of(line: Column) -> Column:
        # every number is put between marks first, so that what stands around it can be looked at without taking a part of it
        marked = F.regexp_replace(W.without_marks(line), r"(?U)(?<![-\[])\b(\d++(?:\.\d++)?+\s*+%?+)", "\u0001$1\u0002")
        found = F.regexp_extract_all(marked, F.lit("\u0001[^\u0002]*%\u0002|(?<![-._/])\u0001[^\u0002]*\u0002(?![-._/])"), F.lit(0))
        return F.filter(F.transform(found, lambda x: T.clean(F.translate(x, "\u0001\u0002", ""))), lambda x: ~x.rlike(r"^(19|20)\d\d$"))

    lines = F.filter(F.split(report, "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit("#")) & ~is_references(x) & F.lower(W.without_marks(x)).rlike(FIGURES))
    return F.array_distinct(F.flatten(F.transform(lines, of)))


def unsupported(report: Column, evidence: Column) -> Column:
    """Figures of a report that its evidence doesn't hold; without evidence none."""
    return T.bind(F.lower(W.without_marks(evidence)), lambda e: F.filter(figures(report), lambda x: (e != "") & ~F.contains(e, x)))


def issues(reports_: DataFrame, questions: DataFrame, sources: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(run, place, issue): what is wrong with each report, in order: its quality, sections, headings of questions, unanswered questions. evidence: (run, evidence)."""
    told = read(reports_)
    held = sources.groupBy("run").agg(F.collect_set(F.col("index").cast("int")).alias("held"))
    rows = told.join(held, "run", "left")
    rows = rows.join(evidence.select("run", "evidence"), "run", "left") if evidence is not None else rows.withColumn("evidence", F.lit(None).cast("string"))
    empty = F.col("report") == ""
    away = F.array_sort(F.array_except("cited", "held"))
    figures_ = unsupported(F.col("report"), F.col("evidence"))
    marks = F.array_join(F.transform(away, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), ", ")
    rules = [
        (empty, F.lit("report is empty")),
        (~empty & ~F.exists(F.split("report", "\n"), is_references), F.lit("report must include a References section")),
        (~empty & F.col("report").rlike(PLACEHOLDER), F.lit("report contains placeholder or non-source citation markers")),
        (~empty & F.col("held").isNotNull() & (F.size(away) > 0), F.concat(F.lit("report uses unavailable citations: "), marks)),
        (~empty & (F.size(figures_) > 0), F.concat(F.lit("report includes benchmark metrics not present in evidence: "), F.array_join(F.slice(figures_, 1, LISTED), ", "))),
        *((~F.arrays_overlap("titles", F.array(*map(F.lit, names))), F.lit(f"missing schema section: {label}")) for label, names in SECTIONS),
    ]
    own = problems(rows, ["run"], rules).select("run", F.lit(0).alias("part"), F.col("place").alias("number"), F.col("problem").alias("issue"))
    asked = coverage(told, questions)
    unplaced = asked.filter("NOT placed").select("run", F.lit(1).alias("part"), "number", F.concat(F.lit("missing planner topic section: "), F.col("heading")).alias("issue"))
    unanswered = asked.filter("NOT covered").select("run", F.lit(2).alias("part"), "number", F.concat(F.lit("missing planner topic: "), F.col("question")).alias("issue"))
    every = own.unionByName(unplaced).unionByName(unanswered)
    return every.select("run", F.row_number().over(Window.partitionBy("run").orderBy("part", "number", "issue")).alias("place"), "issue")


def finished(reports_: DataFrame, sources: DataFrame) -> DataFrame:
    """(run, report): reports without marks of sources that they don't have, with one list of references at the end, in order of first citation; of an index's addresses the largest."""
    held = sources.groupBy("run").agg(F.collect_set(F.col("index").cast("int")).alias("held"))
    text = reports.clean_markdown(F.col("report"))
    known = lambda m: F.col("held").isNull() | F.array_contains("held", m.cast("int"))
    kept = reports.replace_each(text, r"\[([0-9]+)\]", lambda m: F.when(known(m), F.concat(F.lit("["), m, F.lit("]"))).otherwise(""))
    rows = reports_.join(held, "run", "left").select("run", F.regexp_replace(kept, r"(?m)^(\s{0,3}#{1,6}\s+)#{1,6}\s+", "$1").alias("report"))
    lines = rows.select("run", F.posexplode(F.split("report", "\n")).alias("at", "line"))
    event = F.when(is_references(F.col("line")), 1).when(F.startswith("line", F.lit("## ")), 0)
    skipped = F.coalesce(F.last(event, True).over(Window.partitionBy("run").orderBy("at")), F.lit(0))
    body = lines.withColumn("skipped", skipped).groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("skipped") == 0, F.struct("at", "line")))), lambda x: x["line"]), "\n").alias("body"))
    body = body.withColumn("body", reports.clean_markdown(F.col("body")))
    cited = body.select("run", F.posexplode(F.array_distinct(T.citations(F.col("body")))).alias("at", "index"))
    address = sources.select("run", F.col("index").cast("int").alias("index"), T.clean(F.col("url")).alias("url")).groupBy("run", "index").agg(F.max("url").alias("url"))
    listed = cited.join(address, ["run", "index"], "left").withColumn("line", F.when(F.col("url").isNotNull(), F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("url"))))
    listed = listed.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line")))), lambda x: x["line"]), "\n").alias("list"))
    end = F.coalesce("list", F.lit("No cited source markers were used."))
    return body.join(listed, "run", "left").select("run", reports.clean_markdown(F.concat(F.col("body"), F.lit("\n\n## References\n"), end)).alias("report"))


# -- what is asked again ------------------------------------------------------------------------------------------------


def gap_notes(synthesis: Column) -> Column:
    """The lines of an answer that tell of missing evidence, without marks."""
    lines = F.filter(F.transform(F.split(reports.clean_markdown(synthesis), "\n"), T.clean), lambda x: has_any(F.lower(x), GAP_NOTES))
    return T.distinct_ignoring_case(F.transform(lines, lambda x: F.substring(W.without_marks(x), 1, NOTE)))


def _plain(c: Column) -> Column:
    return T.clean(F.regexp_replace(F.regexp_replace(F.regexp_replace(T.text(c), r"`([^`]*)`", "$1"), "[*_#]+", ""), r"\[\d+\]", ""))


def gap_items(synthesis: Column) -> Column:
    """An answer's gaps: table rows whose status or notes tell of one (first cell and notes), and lines with a phrase that does."""

    def of(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), _plain)
        status, notes = F.lower(F.element_at(cells, 2)), T.clean(F.array_join(F.slice(cells, 3, 10**6), " "))
        told = has_any(status, ("missing", "partial")) | F.contains(F.lower(notes), F.lit("missing evidence"))
        is_row = F.startswith(line, F.lit("|")) & ~F.contains(line, F.lit("---")) & (F.size(cells) >= 2)
        row = F.when(is_row & ~F.lower(F.element_at(cells, 1)).isin(*TABLE_HEADS) & told, T.clean(F.concat_ws(" ", F.element_at(cells, 1), notes)))
        return F.coalesce(F.nullif(row, F.lit("")), F.when(has_any(F.lower(line), GAP_PHRASES), F.substring(_plain(line), 1, NOTE)))

    lines = F.filter(F.transform(F.split(reports.normal_citations(synthesis), r"\R"), T.clean), lambda x: x != "")
    return T.distinct_ignoring_case(F.filter(F.transform(lines, of), lambda x: x.isNotNull() & (x != "")))


def requirements(instruction: Column) -> Column:
    """An instruction's requirements: its numbered items if there are two or more, else its bullets, else the whole."""
    ends = r"^[ ;,.]+|[ ;,.]+$"
    numbered = F.slice(F.split(T.clean(instruction), r"(?:^|\s)(?:\(\d+\)|\d+[.)])\s+", -1), 2, 10**6)
    items = F.transform(numbered, lambda x: F.regexp_replace(F.regexp_replace(T.clean(F.regexp_replace(x, ends, "")), r"(?U)(?:,\s*)?\band$", ""), ends, ""))
    bullets = F.filter(F.transform(F.split(T.text(instruction), r"\R"), F.trim), lambda x: x.rlike("^[-*]"))
    points = T.clean_list(F.transform(bullets, lambda x: F.regexp_replace(x, "^[-* ]+", "")))
    whole = T.clean_list(F.array(instruction))
    return T.distinct_ignoring_case(F.when(F.size(numbered) >= 2, T.clean_list(items)).when(F.size(points) > 0, points).otherwise(whole))


def gaps(answers: DataFrame, questions: DataFrame, statuses: DataFrame) -> DataFrame:
    """(run, place, number, question, reason): the questions that an answer (run, synthesis) leaves open: 'status' by its own account (statuses: run, number, status), 'terms' where it lacks
    their terms, 'notes' where its notes on gaps have one of their terms. Each question once, by its first reason."""
    text = T.clean(F.col("synthesis"))
    told = answers.select("run", W.technical_terms(text).alias("terms"), F.lower(F.array_join(gap_notes(text), "\n")).alias("notes"))
    asked = questions.select("run", "number", T.clean(F.col("question")).alias("question")).filter("question <> ''")
    said = statuses.groupBy("run", "number").agg(F.max(has_any(F.lower(T.clean(F.col("status"))), GAP_STATUS)).alias("open"))
    rows = asked.join(told, "run", "left").join(said, ["run", "number"], "left")
    terms, notes = F.coalesce("terms", F.array().cast("array<string>")), F.coalesce("notes", F.lit(""))
    reason = F.when(F.coalesce("open", F.lit(False)), 0).when(~covers(terms, F.col("question")), 1).when(F.exists(W.detail_terms(F.col("question")), lambda t: F.contains(notes, t)), 2)
    rows = rows.select("run", "number", "question", reason.alias("r")).filter("r IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("run").orderBy("r", "number"))
    return rows.select("run", place.alias("place"), "number", "question", F.element_at(F.array(*map(F.lit, ("status", "terms", "notes"))), F.col("r") + 1).alias("reason"))


def gap_queries(open_: DataFrame, objectives: DataFrame) -> DataFrame:
    """(run, place, number, query): what open questions are searched by. objectives: (run, objective)."""
    made = F.substring(T.clean(F.concat_ws(" ", T.text(F.col("objective")), F.col("question"), F.lit(ASK))), 1, QUERY)
    return open_.join(objectives.select("run", "objective"), "run", "left").select("run", "place", "number", made.alias("query"))


def task_details(questions: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run, number, details): what a run's tasks (run, position, query_context, extraction_goal, expected_signals, url) add to each question, of tasks with the question's own text or enough of its words."""
    told = tasks.select("run", "position", T.clean(F.col("query_context")).alias("context"), F.array("extraction_goal", F.array_join(T.clean_list(F.col("expected_signals")), " "), "url").alias("parts"))
    told = told.withColumn("ct", W.query_tokens(F.col("context"))).filter(F.size("ct") > 0)
    asked = questions.select("run", "number", T.clean(F.col("question")).alias("question")).withColumn("qt", W.query_tokens(F.col("question")))
    near = (F.lower("context") == F.lower("question")) | (W.overlap(F.col("qt"), F.col("ct")) >= MATCHED)
    met = asked.join(told, "run").filter(near).select("run", "number", F.struct("position", F.array_join(T.clean_list(F.col("parts")), " ").alias("d")).alias("d"))
    return met.groupBy("run", "number").agg(T.clean(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda x: x["d"]), " ")).alias("details"))


# -- validators ---------------------------------------------------------------------------------------------------------


def problems(df: DataFrame, key: list[str], rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    """(key, place, problem): a row for each rule whose condition holds, by its place among the rules. A null condition doesn't hold."""
    found = F.filter(F.array(*(F.when(broken, F.struct(F.lit(k).alias("place"), said.alias("problem"))) for k, (broken, said) in enumerate(rules))), lambda x: x.isNotNull())
    return df.select(*key, F.explode(found).alias("x")).select(*key, "x.place", "x.problem")


def _blank(name: str) -> Column:
    return T.clean(F.col(name)) == ""


#: Fields that a task must have.
TASK_FIELDS = ("query_context", "url", "source_type", "extraction_goal")


def plan_problems(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run, place, problem) of plans (run, objective, asked, sub_questions) and their tasks (run, position from 1 and TASK_FIELDS): the plan's first, then its tasks' in order."""
    n = tasks.groupBy("run").agg(F.count("*").alias("n_tasks"))
    rows = plans.join(n, "run", "left")
    other = ~_blank("asked") & (F.lower(T.clean(F.col("objective"))) != F.lower(T.clean(F.col("asked"))))
    own = problems(rows, ["run"], [
        (_blank("objective"), F.lit("research_plan.objective is required")), (other, F.lit("research_plan.objective does not match requested objective")),
        (F.coalesce(F.size("sub_questions"), F.lit(0)) <= 0, F.lit("research_plan.sub_questions is required")), (F.col("n_tasks").isNull(), F.lit("research_plan.tasks is required")),
    ])
    each = problems(tasks.withColumn("__n", F.col("position").cast("string")), ["run", "position"], [(_blank(f), F.concat(F.lit("task "), F.col("__n"), F.lit(f".{f} is required"))) for f in TASK_FIELDS])
    every = own.select("run", F.lit(0).alias("part"), "place", "problem").unionByName(each.select("run", F.col("position").cast("int").alias("part"), "place", "problem"))
    return every.select("run", F.row_number().over(Window.partitionBy("run").orderBy("part", "place")).alias("place"), F.concat(F.lit("planner_node "), F.col("problem")).alias("problem"))


def payload_problems(payloads: DataFrame, node: str, text: str) -> DataFrame:
    """(run, place, problem) of what a node hands on (run, objective, planned, its text, n_sources): text is 'synthesis' or 'report'."""
    name = f"{node} payload"
    planned = ~_blank("planned") & (F.lower(T.clean(F.col("objective"))) != F.lower(T.clean(F.col("planned"))))
    matches = (planned, F.lit(f"{name}.objective does not match research_plan.objective"))
    lacks = (_blank(text), F.lit(f"{name}.{text} is required"))
    if text == "report":
        rules = [matches, lacks, (~F.contains(F.lower(T.text(F.col(text))), F.lit("references")), F.lit(f"{node} report must include a References section"))]
    else:
        rules = [(_blank("objective"), F.lit(f"{name}.objective is required")), matches, lacks, (F.coalesce("n_sources", F.lit(0)) <= 0, F.lit(f"{name}.sources is required"))]
    return problems(payloads, ["run"], rules)


def browser_problems(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """(run, problem) of runs without results, or without a source (run, url, full_content) that has an address and a text."""
    told = sources.groupBy("run").agg(F.count_if(~_blank("url") & ~_blank("full_content")).alias("usable"))
    rows = runs.select("run").join(told, "run", "left")
    said = F.when(F.col("usable").isNull(), "browser_node produced no browser_results").when(F.col("usable") == 0, "browser_node produced no useful sources")
    return rows.select("run", said.alias("problem")).filter("problem IS NOT NULL")
