"""What a fetched page says: key sentences, prices, snippets with signals, and whether it is of use for its task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions import text as T
from ..functions import urls as U
from . import context, planner

SHORT, TRUSTED, FALLBACK, OVERLAP = 300, 1_000, 800, 0.06
SNIPPET, CANDIDATES, SNIPPETS = 900, 40, 2
# Words of sentences, sections, rows and noise.
KEY_WORDS = (
    "architecture", "attention", "benchmark", "comparison", "component", "context", "dependency", "gate", "limitation", "memory", "model", "performance", "price", "pricing", "tokens", "input",
    "output", "cached", "cache", "batch", "free tier", "rate limit", "recurrent", "sequence", "state", "training", "transformer", "use case",
)
SECTION_WORDS = ("pricing", "model input", "cached input", "cache writes", "output", "batch", "free tier", "rate limit", "context", "tokens", "discount")
NOISY = (
    "linkedin", "twitter", "facebook", "gmail", "copy_link", "cookie", "privacy policy", "terms of service", "careers", "get started", "our services", "our work", "partnership", "log in", "sign up",
    "navbar", "footer",
)
PROVIDERS = ("gpt", "claude", "gemini", "llama", "mistral", "qwen", "deepseek", "groq", "openai", "anthropic", "google", "model")
PRICE_WORDS = ("input", "output", "cached", "cache", "token", "mtok", "batch", "context", "rate limit", "requests", "tpm", "rpm")
DICTIONARIES = ("dictionary.com", "merriam-webster.com", "vocabulary.com")
PRICE = r"\$[\d,]+(?:\.\d+)?"
PRICE_PATTERNS = (
    r"(?i)(?:model|input|output|cached|cache|batch|price|pricing|token|free tier|rate limit|context)[^.]{0,220}(?:\$[\d.,]+|percent|free|tokens?|requests?)[^.]{0,220}",
    r"(?i)[A-Za-z0-9_.-]{2,40}[^.]{0,160}\$[\d.,]+[^.]{0,180}(?:input|output|tokens?|cached|batch|context)?",
    r"(?i)(?:\$[\d.,]+)[^.]{0,220}(?:per|/)\s*(?:1m|million|token|tokens|request|requests|minute|hour|day)",
)
SIGNAL = (
    r"(?iU)\b(definition|defined\s+as|equation|formula|theorem|algorithm|benchmark|score|accuracy|precision|recall|f1|auc|bleu|rouge|latency|throughput|cost|price|rate|table|"
    r"api|signature|parameter|argument|class|function|method|complexity|memory|runtime|quadratic|linear|o\()\b"
)
FORMULA = r"(?iU)(?:\\(?:frac|sum|sqrt|operatorname)|[=∑Σ√αβγδθλµπ]|\b(?:equation|formula|softmax|sqrt|tanh|exp|log|argmax|argmin)\b|\b[A-Za-z_][A-Za-z0-9_]*\s*\([^)]{0,80}\)\s*=)"
METRIC = r"(?iU)\b\d+(?:\.\d+)?\s*(?:%|bleu|rouge|f1|auc|accuracy|precision|recall|ms|s|tokens/s|score)\b"
CALL = r"(?U)\b[A-Za-z_][A-Za-z0-9_.]*\([^)]{1,120}\)|\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_.]*\b"

#: With what the words of SIGNAL begin.
SIGNAL_LETTERS = "defabsprltcmqoDEFABSPRLTCMQO"
FORMULA_WORDS = ("equation", "formula", "softmax", "sqrt", "tanh", "exp", "log", "argmax", "argmin")
#: Before a \b where a word begins, so that most places fall out before it, which is slow for Unicode: after a letter, digit or underscore of ASCII no word begins.
FRONT = r"(?<!(?-iU:\w))"


def quick(pattern: str) -> str:
    """A pattern with the same matches that passes over other places faster: a name isn't given back letter by letter where the character after it can be none of its own."""
    for plain, kept in ((r"[A-Za-z0-9_]*\s*\(", r"[A-Za-z0-9_]*+\s*+\("), (r"[A-Za-z0-9_.]*\(", r"[A-Za-z0-9_.]*+\("), (r"[A-Za-z0-9_]*\.", r"[A-Za-z0-9_]*+\."), ("[=∑", r"(?=(?-iU:[=[^\x00-\x7F]]))[=∑")):
        pattern = pattern.replace(plain, kept)
    pattern = pattern.replace(r"\b(definition|defined", rf"(?=(?-iU:[{SIGNAL_LETTERS}[^\x00-\x7F]]))\b(definition|defined")
    return re.sub(r"(?:\(\?=\(\?-iU:\[[a-zA-Z]+\[\^[^)]*\)\))?\\b(?=[(\[]|\\d)", lambda m: FRONT + m[0], pattern)


def places(c: Column, pattern: str) -> Column:
    """(start, end), from 0, of every match: what the split leaves stands between matches."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, z: Column) -> Column:
        start = s["at"] + z["p"]
        return F.struct((start + z["m"]).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), (start + z["m"]).alias("end")))).alias("out"))

    def of(found: Column) -> Column:
        between = F.slice(F.split(c, pattern, -1), 1, F.size(found))
        sizes = F.zip_with(between, found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
        return F.when(F.size(found) == 0, first["out"]).otherwise(F.aggregate(sizes, first, step, lambda s: s["out"]))

    return T.bind(W.every(c, pattern), of)


def starts(c: Column, pattern: str) -> Column:
    """Where, from 0, matches of a pattern begin that have no such beginning inside; in one pass, as a text is cut before each of them."""
    first = F.struct(F.lit(0).alias("at"), F.when(c.rlike(rf"\A(?:{pattern})"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("out"))

    def step(s: Column, n: Column) -> Column:
        return F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out"))

    def of(parts: Column) -> Column:
        return F.aggregate(F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length), first, step, lambda s: s["out"])

    return T.bind(F.split(c, f"(?={pattern})", -1), of)


def around(c: Column, start: Column, end: Column) -> Column:
    """c[start:end] by positions from 0 that may lie outside."""
    low = F.greatest(start, F.lit(0))
    return F.substr(c, low + 1, F.greatest(end - low, F.lit(0)))


def key_sentences(c: Column, limit: int = 12) -> Column:
    """The first sentences that hold a key word; without any, the first ones."""
    parts = F.filter(F.transform(F.split(F.replace(T.text(c), F.lit("\n"), F.lit(" ")), r"\."), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    def of(every: Column) -> Column:
        told = F.filter(every, lambda x: planner.has_any(F.lower(x), KEY_WORDS))
        return F.transform(F.slice(F.when(F.size(told) > 0, told).otherwise(every), 1, limit), lambda x: F.substring(x, 1, 500))

    return T.bind(parts, of)


def useful_price_snippet(c: Column) -> Column:
    brackets = F.length(c) - F.length(F.regexp_replace(c, r"[\[\]]", ""))
    return (F.length(c) > 20) & ~planner.has_any(F.lower(c), NOISY) & (brackets <= 4) & ~F.contains(c, F.lit("http"))


def _row(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]+\)", " "), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return T.clean(F.regexp_replace(F.regexp_replace(bare, r"(?U)https?://\S+", " "), r"(?U)\s*\|\s*", " | "))


def useful_price_row(c: Column) -> Column:
    lower = F.lower(c)
    prices = F.length(c) - F.length(F.replace(c, F.lit("$"), F.lit("")))
    named = planner.has_any(lower, PROVIDERS)
    told = (named & planner.has_any(lower, PRICE_WORDS)) | (F.contains(c, F.lit("|")) & (prices >= 2)) | ((F.length(c) < 260) & (prices >= 1) & named)
    return useful_price_snippet(c) & ((prices > 0) | F.contains(lower, F.lit("free of charge"))) & told


def price_rows(c: Column, limit: int = 80) -> Column:
    """Different lines that give a price."""
    rows = F.filter(F.transform(F.split(T.text(c), r"\r\n|[\n\r]"), _row), lambda x: (x != "") & useful_price_row(x))
    return F.slice(F.transform(F.array_distinct(rows), lambda x: F.substring(x, 1, 1000)), 1, limit)


def price_facts(c: Column, limit: int = 30) -> Column:
    """Different passages around amounts; without any, those that the patterns tell, one pattern after the other."""
    value = T.text(c)
    near = F.transform(places(value, PRICE), lambda m: T.clean(around(value, m["start"] - 180, m["end"] + 260)))
    keep = lambda x: F.array_distinct(F.filter(x, useful_price_snippet))
    told = keep(F.flatten(F.array(*(F.transform(W.every(value, p), T.clean) for p in PRICE_PATTERNS))))
    return T.bind(keep(near), lambda n: F.transform(F.slice(F.when(F.size(n) > 0, n).otherwise(told), 1, limit), lambda x: F.substring(x, 1, 700)))


def price_sections(c: Column, limit: int = 12) -> Column:
    """Different passages around price words, one word after the other."""
    value, lower = T.text(c), F.lower(T.text(c))
    near = (F.transform(places(lower, w), lambda m: T.clean(around(value, m["start"] - 250, m["start"] + 900))) for w in SECTION_WORDS)
    return F.slice(F.array_distinct(F.filter(F.flatten(F.array(*near)), lambda x: x != "")), 1, limit)


def snippet(c: Column, size: Column, at: Column, most: int = SNIPPET) -> Column:
    """A cleaned text of that size around a place, trimmed to whole sentences where it is cut."""
    half = most // 2

    def begun(cut: Column) -> Column:
        return F.when(at > half, F.regexp_replace(cut, r"(?s)\A.*?(?<=[.!?])\s+(?=[A-Z0-9`(])", "")).otherwise(cut)

    def whole(cut: Column) -> Column:
        ended = lambda: T.bind(F.regexp_extract(cut, r"(?s)\A(.*[.!?])(?=\s+[A-Z0-9`(]|\z)", 1), lambda e: F.when(e != "", e).otherwise(cut))
        return F.when(at + half < size, ended()).otherwise(cut)

    cut = T.bind(F.trim(around(c, at - half, F.least(size, at + half))), begun)
    return F.trim(F.substring(T.bind(cut, whole), 1, most))


def snippet_score(c: Column) -> Column:
    """What a passage shows of formulas, figures and calls. A pattern is only tried where the passage holds what each of its matches does; as upper and lower case of other characters may equal ASCII's, its words only decide in an ASCII passage."""

    def of(x: Column) -> Column:
        s = x["s"]
        holds = lambda words: ~x["ascii"] | planner.has_any(x["low"], words)
        n = lambda may, p, most, each: F.when(may, F.least(F.lit(most), F.size(W.every(s, quick(p)))) * each).otherwise(0)
        told = lambda words, more: F.when(holds(words) & s.rlike(quick(rf"(?iU)\b(?:{'|'.join(words)})\b")), more).otherwise(0)
        score = n(holds(("\\", "=", *FORMULA_WORDS)), FORMULA, 5, 4) + n(s.rlike(r"(?U)\d"), METRIC, 4, 3) + n(F.contains(s, F.lit("(")) | s.rlike(r"\.[A-Za-z_]"), CALL, 3, 2)
        return score + told(("equation", "formula", "definition", "defined as", "theorem", "algorithm"), 3) + told(("benchmark", "score", "accuracy", "latency", "throughput", "cost", "complexity"), 2)

    return T.bind(F.struct(c.alias("s"), F.lower(c).alias("low"), (F.length(c) == F.octet_length(c)).alias("ascii")), of)


def signal_snippets(content: Column, most: int = SNIPPETS) -> Column:
    """A page's best passages around signal words, as (score, at, snippet): of its first CANDIDATES that are evidence, the highest scores, then the earliest. Passages are made one after the other, until there are so many."""
    none = F.array().cast("array<struct<minus:int,at:int,s:string>>")

    def candidates(x: Column) -> Column:
        def step(out: Column, at: Column) -> Column:
            more = lambda s: F.when(context.meaningful(s), F.concat(out, F.array(F.struct((-snippet_score(s)).alias("minus"), at.alias("at"), s.alias("s"))))).otherwise(out)
            return F.when(F.size(out) >= CANDIDATES, out).otherwise(T.bind(snippet(x["v"], x["n"], at), more))

        return F.aggregate(starts(x["v"], quick(SIGNAL)), none, step)

    def ranked(v: Column) -> Column:
        return F.array_sort(T.bind(F.struct(v.alias("v"), F.length(v).alias("n")), candidates))

    once = T.bind(T.bind(T.clean(content), ranked), lambda r: T.bind(r["s"], lambda every: F.filter(r, lambda x, i: F.array_position(every, x["s"]) == i + 1)))
    return F.transform(F.slice(once, 1, most), lambda x: F.struct((-x["minus"]).alias("score"), x["at"].alias("at"), x["s"].alias("snippet")))


def signal_results(sources: DataFrame, by: list[str], most_sources: int = 6) -> DataFrame:
    """(by, place, url, id, title, snippet, score) of sources (by, position, url, title, content): the snippets of each run's first `most_sources` sources that have any, two a source, a snippet once for each address.

    Three levels of limits, and none needs a group of all snippets: candidates and snippets are cut within a row, sources by a limit that Spark applies before it moves rows.
    """
    told = F.explode(F.filter(F.array(signal_snippets(F.col("content"))), lambda s: F.size(s) > 0)).alias("s")  # not a filter on them, for which they would be made twice
    rows = sources.filter(F.col("url") != "").select("*", told)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("position"))
    first = rows.select(*by, "position", "url", F.coalesce(F.nullif(T.clean(F.col("title")), F.lit("")), F.col("url")).alias("title"), "s").withColumn("nth", nth).filter(F.col("nth") <= most_sources)
    each = first.select(*by, "nth", "url", "title", F.posexplode("s").alias("n", "x"))
    key = F.substring(F.lower("x.snippet"), 1, 240)
    once = each.withColumn("r", F.row_number().over(Window.partitionBy(*by, "url", key).orderBy("nth", "n"))).filter("r = 1")
    digest = F.substring(F.sha2(F.concat_ws(":", "url", F.col("n").cast("string"), "x.snippet"), 256), 1, 24)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("nth", "n"))
    return once.select(*by, place.alias("place"), "url", F.concat(F.lit("browser-signal-"), digest).alias("id"), "title", F.col("x.snippet").alias("snippet"), F.col("x.score").alias("score"))


def no_task() -> dict[str, Column]:
    """A task that asks for nothing: rules about a task let every source pass."""
    blank = {x: F.lit("") for x in ("url", "source_type", "query_context", "extraction_goal", "target_name")}
    return blank | {"expected_signals": F.array().cast("array<string>")}


def quality_note(title: Column, preview: Column, content: Column, url: Column, task: dict[str, Column]) -> Column:
    """The first rule that a fetched source meets. task: url, source_type, query_context, extraction_goal, target_name, expected_signals."""
    front = F.concat_ws(" ", T.clean(title), T.clean(preview))
    size = F.length(content)
    wanted = F.concat_ws(" ", T.clean(task["query_context"]), T.clean(task["extraction_goal"]), T.clean(task["target_name"]), F.array_join(T.clean_list(task["expected_signals"]), " "))
    told = W.source_terms(F.concat_ws(" ", front, F.substring(T.clean(content), 1, 3000)))
    dictionary = planner.has_any(planner.host_of(url), DICTIONARIES) & ~planner.has_any(F.lower(wanted), ("definition", "meaning", "etymology", "word"))
    pricing = planner.is_pricing_task(task["source_type"], task["query_context"], task["extraction_goal"], task["expected_signals"])
    plain = F.concat_ws("\n", T.clean_list(F.split(T.text(content), "\n")))
    unpriced = pricing & (F.size(price_rows(plain)) == 0) & (F.size(price_facts(plain)) == 0) & (F.size(key_sentences(plain)) == 0)
    planned = T.clean(task["url"])
    own = (planned != "") & ~F.startswith(planned, F.lit("SEARCH:")) & (T.clean(url) != "") & (planner.url_key(planned) == planner.url_key(T.clean(url)))
    trusted = own & (size >= TRUSTED) & U.authoritative(T.clean(url))
    name = T.clean(task["target_name"])
    target = W.source_terms(name)
    off_target = (name != "") & (F.lower(name) != "general research") & (F.size(target) > 0) & ~F.arrays_overlap(target, told)
    asked = W.source_terms(wanted)
    off_task = (F.size(asked) > 0) & (W.overlap(asked, told) < OVERLAP)
    return (
        F.when(T.blocked(F.concat_ws(" ", front, F.substring(T.clean(content), 1, 1000))), "blocked").when(size < SHORT, "empty or short").when(dictionary, "dictionary").when(T.not_found(front), "not found")
        .when(unpriced, "no prices").when(trusted, "trusted").when(off_target, "off target").when(off_task, "low overlap").otherwise("passed")
    )


def useful(note: Column, pricing: Column, facts: Column, sections: Column, size: Column) -> Column:
    """Whether a source is of use for its task, from the rule that it meets (quality_note()), whether the task asks for prices, and how many facts, sections and characters it has. A priced source of a pricing task needs nothing else; others must be trusted, or fit target and task and say something."""
    return (
        F.when(note.isin("blocked", "empty or short", "dictionary", "not found", "no prices"), False).when(pricing | (note == "trusted"), True).when(note.isin("off target", "low overlap"), False)
        .otherwise((facts > 0) | (sections > 0) | (size >= FALLBACK))
    )
