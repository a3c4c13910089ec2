"""The context of an answer: what is evidence, which sources come first, selection for questions, packing to a budget, coverage.

Rows are hits (run, position, id, document, title, url, source_type, contexts, parent_id, score); a run is one answer, with
at most some hundred hits, and all of its rows are ordered by windows within the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions import text as T
from . import reports

BUDGET, BLOCK, LEAST_BLOCK, BLOCKS, SHORTEST = 18_000, 750, 700, 14, 500
CHUNKS, PER_QUESTION = 18, 3
EVIDENCE_CHARS, EVIDENCE_TOKENS = 120, 12
SECTION = 1_800
#: Types and addresses of primary sources.
PRIMARY_TYPES = ("arxiv", "academic", "docs", "benchmarks", "pricing")
PRIMARY_URLS = ("arxiv.org/pdf/", "arxiv.org/abs/", "openreview.net/pdf", "tensorflow.org", "pytorch.org", ".edu", "doi.org")
#: Kinds of evidence and the questions that ask for them, when an answer is checked and when a plan is made.
ANSWER_EVIDENCE = (
    ("definition", r"\b(what is|definition|define|purpose|overview)\b"),
    ("equation", r"\b(equation|formula|formulation|mathematical|components?)\b"),
    ("comparison", r"\b(compare|comparison|versus| vs |differ|differences?)\b"),
    ("benchmark", r"\b(benchmark|score|performance|metric|accuracy|bleu|glue|imagenet|result)\b"),
    ("api", r"\b(api|pytorch|tensorflow|keras|implementation|code|signature|usage)\b"),
    ("complexity", r"\b(complexity|memory|time|efficient|linear|quadratic|scalability)\b"),
    ("applications", r"\b(application|use case|vision|nlp|computer vision)\b"),
    ("limitations", r"\b(limitation|challenge|drawback|open question)\b"),
)
PLAN_EVIDENCE = (
    ("definition", r"\b(what is|define|definition|meaning|overview|purpose)\b"),
    ("equation", r"\b(equation|formula|formulation|mathematical|components?)\b"),
    ("comparison", r"\b(compare|comparison|versus| vs |differ|differences?|trade[- ]?off)\b"),
    ("benchmark", r"\b(benchmark|score|performance|metric|accuracy|bleu|glue|imagenet|result)\b"),
    ("api", r"\b(api|pytorch|tensorflow|keras|implementation|code|usage|signature)\b"),
    ("complexity", r"\b(complexity|memory|latency|throughput|efficient|linear|quadratic|scalability)\b"),
    ("limitations", r"\b(limitation|challenge|drawback|risk|open question)\b"),
    ("applications", r"\b(application|use case|used in|vision|nlp|computer vision)\b"),
)
#: Fixed value: where the section of the next question begins.
NEXT_QUESTION = r"\n\s*(?:#{1,6}\s+|\d+\.\s+|[-*]\s+)?(?:What|How|Why|Which|When|Where)\b"


def evidence_types(c: Column, kinds=ANSWER_EVIDENCE) -> Column:
    lower = F.lower(T.clean(c))
    found = F.filter(F.array(*(F.when(lower.rlike(f"(?U){p}"), F.lit(n)) for n, p in kinds)), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("evidence"))).otherwise(found)


def is_primary(source_type: Column, url: Column) -> Column:
    found = F.lower(T.clean(source_type)).isin(*PRIMARY_TYPES)
    for part in PRIMARY_URLS:
        found = found | F.contains(F.lower(T.text(url)), F.lit(part))
    return found


def has_stored_header(c: Column) -> Column:
    return T.bind(F.lower(T.clean(c)), lambda lower: F.startswith(lower, F.lit("source:")) & F.contains(lower, F.lit(" url:")) & F.contains(lower, F.lit(" task:")))


def meaningful(c: Column) -> Column:
    """Long enough for evidence, and not just what was stored about it."""

    def of(value: Column) -> Column:
        return (F.length(value) >= EVIDENCE_CHARS) & (F.size(W.every(value, "[A-Za-z0-9_]+")) >= EVIDENCE_TOKENS) & ~has_stored_header(value)

    return T.bind(T.clean(c), of)


def without_header(document: Column, title: Column, url: Column, contexts: Column) -> Column:
    """A stored chunk without its Source, URL and Task lines; in a flattened one, what follows the header or the task."""
    lines = F.filter(F.split(T.text(document), "\n"), lambda x: ~x.rlike("^(Source|URL|Task): "))
    task = T.clean(F.concat(F.lit("Task: "), T.clean(contexts)))
    names = (F.coalesce(F.nullif(T.clean(title), F.lit("")), T.clean(url)), T.clean(url))
    heads = [T.clean(F.concat(F.lit("Source: "), name, F.lit(" URL: "), T.clean(url), F.lit(" "), task)) for name in names]
    parts = F.struct(
        T.clean(document).alias("flat"), F.when(F.contains(T.text(document), F.lit("\n")), T.clean(F.array_join(lines, "\n"))).otherwise("").alias("body"),
        task.alias("task"), *(h.alias(f"h{k}") for k, h in enumerate(heads)),
    )

    def of(x: Column) -> Column:
        flat = x["flat"]
        rest = F.when(F.contains(flat, x["task"]), T.clean(F.substr(flat, F.call_function("locate", x["task"], flat) + F.length(x["task"])))).otherwise(flat)
        for k in (1, 0):
            rest = F.when(F.startswith(flat, x[f"h{k}"]), T.clean(F.substr(flat, F.length(x[f"h{k}"]) + 1))).otherwise(rest)
        return F.when(x["body"] != "", x["body"]).otherwise(rest)

    return T.bind(parts, of)


def preview(document: Column, title: Column, url: Column, contexts: Column, most: int | Column) -> Column:
    """The beginning of a chunk's own text; '' where that is no evidence."""
    size = F.greatest(F.lit(80), F.lit(most) if isinstance(most, int) else most)
    cut = lambda body: F.trim(F.substr(F.when((body == "") & ~has_stored_header(document), T.clean(document)).otherwise(body), F.lit(1), size))
    return T.bind(T.bind(without_header(document, title, url, contexts), cut), lambda c: F.when(meaningful(c), c).otherwise(""))


def evidence_key(parent_id: Column, id_: Column, url: Column, content: Column) -> Column:
    stable = F.coalesce(F.nullif(T.clean(parent_id), F.lit("")), T.clean(id_))
    return T.clean(F.concat(stable, F.lit(":"), T.text(url), F.lit(":"), F.lower(F.substring(T.clean(content), 1, 240))))


def balanced(hits: DataFrame, place: str = "place") -> DataFrame:
    """Round-robin over sources: every source's first hit, then every source's second; sources with a primary hit first, then in order of their first hit. A hit without an address is a source of its own."""
    source = F.coalesce(F.nullif(T.text(F.col("url")), F.lit("")), F.col("id").cast("string"))
    rows = hits.withColumn("__source", source).withColumn("__rank", F.when(is_primary(F.col("source_type"), F.col("url")), 0).otherwise(1))
    own = Window.partitionBy("run", "__source")
    rows = rows.withColumn("__turn", F.row_number().over(own.orderBy("position"))).withColumn("__best", F.min("__rank").over(own)).withColumn("__first", F.min("position").over(own))
    placed = rows.withColumn(place, F.row_number().over(Window.partitionBy("run").orderBy("__turn", "__best", "__first")))
    return placed.drop("__source", "__rank", "__turn", "__best", "__first")


def _about(most: int) -> Column:
    return preview(F.col("document"), F.col("title"), F.col("url"), F.col("contexts"), most)


def meaningful_hits(hits: DataFrame) -> DataFrame:
    """Hits that are evidence, of those with one key the first."""
    rows = hits.withColumn("__p", _about(EVIDENCE_CHARS * 4)).filter("__p <> ''")
    key = evidence_key(F.col("parent_id"), F.col("id"), F.col("url"), F.col("__p"))
    first = F.row_number().over(Window.partitionBy("run", "__k").orderBy("position"))
    return rows.withColumn("__k", key).withColumn("__r", first).filter("__r = 1").drop("__p", "__k", "__r")


def select(hits: DataFrame, questions: DataFrame, most: int = CHUNKS, each: int = PER_QUESTION) -> DataFrame:
    """(run, place, id): for each question (run, number, question) the best hits, then the others by source, `most` in all; each key once. A question's score for a hit is three for each shared token, two for a primary source, one for a positive score; rows that score nothing are left out."""
    good = meaningful_hits(hits).withColumn("key", evidence_key(F.col("parent_id"), F.col("id"), F.col("url"), F.col("document")))
    told = F.concat_ws(" ", T.clean(F.col("title")), T.text(F.col("url")), T.clean(F.col("contexts")), _about(BLOCK))
    priority = F.when(is_primary(F.col("source_type"), F.col("url")), 2).otherwise(0) + F.when(F.col("score") > 0, 1).otherwise(0)
    rows = good.select("run", "position", "id", "key", W.query_tokens(told).alias("t"), priority.alias("p"))
    asked = questions.filter(T.clean(F.col("question")) != "").select("run", "number", W.query_tokens(F.col("question")).alias("q"))
    scored = rows.join(asked, "run").withColumn("s", 3 * F.size(F.array_intersect("q", "t")) + F.col("p")).filter("s > 0")
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("run", "number").orderBy(F.desc("s"), "position"))).filter(F.col("r") <= max(1, each))
    fill = balanced(good, "r").select("run", "id", "key", F.lit(2**31 - 1).alias("number"), "r")
    every = best.select("run", "id", "key", F.col("number").cast("int").alias("number"), "r").unionByName(fill)
    once = every.withColumn("n", F.row_number().over(Window.partitionBy("run", "key").orderBy("number", "r"))).filter("n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("number", "r"))).filter(F.col("place") <= most).select("run", "place", "id")


def pack(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(run, index, retrieval_rank, id, block): numbered blocks in balanced order. Weak chunks are passed over without a number; the block that meets the budget's end is cut if SHORTEST characters are left for it, and it is the last."""
    budget = max(1000, budget)
    run = Window.partitionBy("run")
    rows = balanced(hits, "retrieval_rank").withColumn("__n", F.count_if(T.clean(F.col("document")) != "").over(run))
    limit = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK), F.floor(F.lit(budget) / F.least(F.col("__n"), F.lit(BLOCKS))).cast("int") - 120))
    limit = F.when(F.col("__n") > 0, limit).otherwise(BLOCK)
    rows = rows.withColumn("__p", preview(F.col("document"), F.col("title"), F.col("url"), F.col("contexts"), limit)).filter("__p <> ''")
    rows = rows.withColumn("index", F.row_number().over(run.orderBy("retrieval_rank")))
    number = F.col("index").cast("string")
    title = F.coalesce(F.nullif(T.clean(F.col("title")), F.lit("")), F.nullif(T.text(F.col("url")), F.lit("")), F.concat(F.lit("Source "), number))
    rows = rows.withColumn("block", F.concat(F.lit("["), number, F.lit("] "), title, F.lit("\nURL: "), T.text(F.col("url")), F.lit("\n"), F.col("__p")))
    before = F.coalesce(F.sum(F.length("block")).over(run.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__left", F.lit(budget) - before)
    kept = rows.filter((F.col("__left") >= F.length("block")) | (F.col("__left") >= SHORTEST))
    cut = F.when(F.col("__left") >= F.length("block"), F.col("block")).otherwise(F.regexp_replace(F.substr("block", F.lit(1), F.greatest(F.col("__left"), F.lit(0)).cast("int")), r"(?U)\s+$", ""))
    return kept.select("run", "index", "retrieval_rank", "id", cut.alias("block"))


def diagnostics(hits: DataFrame) -> DataFrame:
    """(run, retrieved, evidence_chunks, weak_chunks, primary_sources)."""
    good = _about(EVIDENCE_CHARS * 3) != ""
    made = hits.groupBy("run").agg(F.count("*").alias("retrieved"), F.count_if(good).alias("evidence_chunks"), F.count_if(is_primary(F.col("source_type"), F.col("url"))).alias("primary_sources"))
    return made.withColumn("weak_chunks", F.col("retrieved") - F.col("evidence_chunks"))


def section_for(synthesis: Column, question: Column) -> Column:
    """A question's part of an answer: from its own words to the next question, else the lines that share enough tokens with it."""
    asked = T.clean(question)
    at = F.call_function("locate", F.lower(asked), F.lower(synthesis))
    after = F.substr(synthesis, at + F.length(asked))
    next_ = F.call_function("regexp_instr", after, F.lit(f"(?iU){NEXT_QUESTION}"))
    found = F.substr(synthesis, at, F.when(next_ > 0, F.length(asked) + next_ - 1).otherwise(SECTION))
    words = W.query_tokens(asked)
    enough = F.greatest(F.lit(2), F.least(F.lit(4), F.size(words)))
    lines = F.array_join(F.filter(F.split(synthesis, "\n"), lambda x: F.size(F.array_intersect(words, W.query_tokens(x))) >= enough), "\n")
    return F.when(asked == "", "").when(at > 0, found).otherwise(lines)


def coverage(questions: DataFrame) -> DataFrame:
    """(run, number, status, source_indexes) of rows (run, number, question, synthesis, indexes): how an answer covers each question, and the sources it cites there."""
    rows = questions.withColumn("__s", section_for(reports.normal_citations(F.col("synthesis")), F.col("question")))
    cited = F.filter(F.array_distinct(T.citations(F.col("__s"))), lambda i: F.array_contains(F.col("indexes"), i))
    return rows.select("run", "number", reports.coverage_status(F.col("__s")).alias("status"), cited.alias("source_indexes"))


def citation_index(sources: DataFrame, run: str = "run") -> DataFrame:
    """(run, id, index): the number under which each chunk is cited; of a chunk's numbers the last."""
    rows = sources.select(run, T.clean(F.col("id").cast("string")).alias("id"), "index", "position").filter("id <> '' AND index IS NOT NULL")
    return rows.groupBy(run, "id").agg(F.max_by("index", "position").alias("index"))
