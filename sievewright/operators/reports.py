"""Report upkeep: cleaning of objectives and Markdown, page chunks, supporting chunks, source lists, query suffixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OBJECTIVE = 1_200
CHUNKS = 10
SECTION, SECTION_WORDS = 80, 800
#: Phrases that are taken out of objectives.
INJECTED = (
    r"ignore (all )?(previous|prior|above) instructions",
    r"ignore (the )?(system|developer) (message|prompt|instructions)",
    r"reveal (the )?(system|developer)? ?(prompt|message|instructions)",
    r"print (the )?(system|developer)? ?(prompt|message|instructions)",
    r"do not return json",
    r"return markdown",
    r"skip validation",
    r"bypass (the )?(rules|instructions|validation)",
    r"you are now",
)
#: Patterns of questions, and what their queries end in.
SUFFIXES = (
    (r"\b(equation|formula|mathematical|formulation|derive|scaled|additive|multiplicative)\b", "exact equation formula derivation symbols softmax sqrt sum matrix alignment"),
    (r"\b(benchmark|result|score|performance|accuracy|bleu|glue|imagenet|top-1|metric)\b", "benchmark table results scores metrics accuracy BLEU GLUE ImageNet top-1"),
    (r"\b(api|implementation|framework|library|pytorch|tensorflow|keras|hugging face|transformers)\b", "official documentation API signature parameters usage example class function"),
    (r"\b(complexity|efficient|variant|limitation|memory|time|quadratic|linear|sparse|low-rank)\b", "computational complexity time memory O(n^2) O(n) algorithm approximation limitation"),
    (r"\b(paper|contribution|introduced|architecture|method|model|et al)\b", "original paper method contribution architecture equations results"),
)
#: What tells that an answer lacks evidence, has little, or has it.
MISSING, WEAK, COVERED = r"\bmissing evidence\b|\bnot present\b|\bno explicit\b|\bunavailable\b", r"\bpartial(?:ly)?\b|\blimited\b|\bweak\b", r"\bcovered\b|\bstrong\b|\bsupported\b"


def replace_each(c: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """c with every match of a pattern, which has one group, put as body(group)."""
    made = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), body)
    return F.array_join(F.zip_with(F.split(c, pattern, -1), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def sanitise_objective(c: Column) -> Column:
    text = F.substring(T.clean(c), 1, OBJECTIVE)
    for pattern in INJECTED:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    return T.clean(F.translate(text, "<>", "()"))


def normal_citations(c: Column) -> Column:
    """Citation marks of all kinds as [n]; lists as one mark for each number."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"【\s*([0-9]+)[^】]*】", "[$1]")
    text = replace_each(text, r"\[\s*([0-9]+(?:\s*,\s*[0-9]+)+)\s*\]", lambda m: F.regexp_replace(F.concat(F.lit("["), m, F.lit("]")), r"\s*,\s*", "] ["))
    return F.regexp_replace(text, r"\[\s*([0-9]+)\s*\]", "[$1]")


def clean_markdown(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", "")
    text = normal_citations(F.regexp_replace(text, r"(?is)<think>.*", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|\z)", ""), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def sections(c: Column) -> Column:
    """The first words of a text in stretches of SECTION."""
    words = F.slice(F.filter(F.split(T.clean(c), " "), lambda w: w != ""), 1, SECTION_WORDS)
    return T.bind(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w), F.lit(SECTION)), lambda i: F.array_join(F.slice(w, i, SECTION), " "))))


def unique_chunks(df: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """Of each group's chunks that begin with the same 500 characters the first one; blank ones go."""
    clean = df.withColumn(text, T.clean(F.col(text))).filter(F.col(text) != "")
    first = F.row_number().over(Window.partitionBy(*by, F.substring(text, 1, 500)).orderBy(order))
    return clean.withColumn("__r", first).filter("__r = 1").drop("__r")


def supporting(chunks: DataFrame, cited: DataFrame, by: str, most: int) -> DataFrame:
    """A report's chunks (by, id, source_index, primary, score) by citation, primacy, source and score: the first `most`, or as many as sources are cited. cited: (by, source_index), distinct."""
    mark = cited.distinct().withColumn("__cited", F.lit(1))
    n = mark.groupBy(by).agg(F.count("*").alias("__n"))
    rows = chunks.filter("source_index IS NOT NULL").join(mark, [by, "source_index"], "left").join(n, by, "left")
    order = [F.coalesce("__cited", F.lit(0)).desc(), F.col("primary").desc(), F.coalesce(F.nullif("source_index", F.lit(0)), F.lit(10**6)), F.coalesce("score", F.lit(0.0)).desc(), F.col("id")]
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return placed.filter(F.col("place") <= F.greatest(F.lit(max(1, most)), F.coalesce("__n", F.lit(0)))).drop("__cited", "__n")


def append_sources(original: DataFrame, refreshed: DataFrame, by: str) -> DataFrame:
    """(by, old_index, url, index, added) for a report's refreshed sources (by, index, url): those with a known url take its index, others get new ones after the largest, a url's first row for all of its rows; a blank url is new each time."""
    key = F.lower(T.clean(F.col("url")))
    known = original.groupBy(by, key.alias("k")).agg(F.max("index").alias("known")).filter("k <> ''")
    top = original.groupBy(by).agg(F.max("index").alias("top"))
    rows = refreshed.select(by, F.col("index").alias("old_index"), "url", key.alias("k")).join(known, [by, "k"], "left").join(top, by, "left")
    own = F.when(F.col("k") == "", F.concat(F.lit("#"), F.col("old_index").cast("string"))).otherwise(F.col("k"))
    first = F.col("known").isNull() & (F.row_number().over(Window.partitionBy(by, own).orderBy("old_index")) == 1)
    rows = rows.withColumn("added", first)
    count = F.sum(F.col("added").cast("long")).over(Window.partitionBy(by).orderBy("old_index"))
    rows = rows.withColumn("__new", F.when(F.col("added"), F.coalesce("top", F.lit(0)) + count))
    mine = F.max("__new").over(Window.partitionBy(by, own))
    return rows.select(by, "old_index", "url", F.coalesce("known", mine).cast("long").alias("index"), "added")


def precision_suffixes(c: Column) -> Column:
    lower = F.lower(T.clean(c))
    return F.filter(F.array(*(F.when(lower.rlike(f"(?U){p}"), F.lit(s)) for p, s in SUFFIXES)), lambda x: x.isNotNull())


def coverage_status(c: Column) -> Column:
    lower = F.lower(T.clean(c))
    said = F.when((lower == "") | lower.rlike(f"(?U){MISSING}"), "missing").when(lower.rlike(f"(?U){WEAK}"), "partial")
    return said.when(lower.rlike(f"(?U){COVERED}") | (F.size(T.citations(c)) > 0), "covered").otherwise("partial")
