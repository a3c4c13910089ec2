"""Planning rules: which tasks a plan keeps, where they look, and how search results rank.

Tasks are rows (plan, position, target_type, target_name, source_type, query_context, extraction_goal, expected_signals, url, priority).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions import text as T

# Hosts, words and weights of the ranking.
OFFICIAL_KEYS = {
    "amazon": ("amazon", "aws"), "amazonaws": ("amazon", "aws"), "anthropic": ("anthropic", "claude"), "aws": ("amazon", "aws"), "azure": ("azure", "microsoft"), "google": ("google", "gemini"),
    "googlecloud": ("google", "gemini"), "groq": ("groq",), "microsoft": ("microsoft", "azure"), "microsoftazure": ("microsoft", "azure"), "openai": ("openai",),
}
ACADEMIC = (".edu", "acm.org", "ieee.org", "nature.com", "mitpressjournals.org")
MIRRORS = ("researchgate.net", "wikipedia.org")
LOW_QUALITY = ("paperdue.com", "studocu.com", "coursehero.com", "chegg.com")
BLOCK_PRONE = ("medium.com", "aiml.com")
BOT_SIGNALS = ("checking the site connection security", "enable cookies", "robot challenge", "captcha", "cloudflare", "access denied")
TOPICS = (
    ("pricing", ("price", "pricing", "cost", "token")), ("growth", ("revenue", "growth", "employee", "market expansion", "strategy")),
    ("technical", ("architecture", "paper", "research", "technical", "rnn", "lstm", "transformer")),
)
WEAK_PRICING = (
    "openai.com/pricing", "www.openai.com/pricing", "chatgpt.com/pricing", "claude.com/pricing", "anthropic.com/pricing", "www.anthropic.com/pricing", "cloud.google.com/ai-platform/pricing",
)
TRUSTED_TECHNICAL = (
    "arxiv.org", "aclanthology.org", "dl.acm.org", "ieee.org", "jmlr.org", "mitpressjournals.org", "nature.com", "nips.cc", "openreview.net", "proceedings.mlr.press", "science.org", "springer.com",
)
THIRD_PARTY = ("salary", "salaries", "review", "reviews", "benchmark", "benchmarks", "sentiment", "news")
PRICING_WORDS = ("price", "pricing", "tokens", "cached input", "batch", "free tier", "rate limits")
QUESTION_TOPICS = (
    (("additional cost", "context length", "embedding", "fine-tuning", "fine tuning"), "additional costs"), (("regional", "region", "data-transfer", "data transfer"), "regional pricing"),
    (("enterprise", "contract", "volume", "discount"), "enterprise discounts"), (("free tier", "pay-as-you-go", "pay as you go", "committed use", "tier"), "pricing tiers"),
    (("compare", "comparison", "across"), "pricing comparison"), (("per-token", "per token", "token price", "base language model"), "token pricing"),
)
TOPIC_STOPWORDS = (
    "a", "additional", "an", "are", "can", "do", "does", "for", "get", "has", "have", "how", "i", "is", "many", "model", "models", "or", "the", "there", "what", "with",
)
SEARCH_ENGINES = ("google.", "bing.com", "duckduckgo.com")


#: Sources that may be named by address, secondary ones, and the modes in which these must show the objective.
DIRECT_TYPES = ("arxiv", "academic", "docs", "benchmarks", "pricing", "careers")
SECONDARY_TYPES = ("news", "reviews", "technical_overview", "webpage", "wikipedia")
BROAD_MODES = ("knowledge_research", "market_research")


def has_any(c: Column, words) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *(F.contains(c, F.lit(w)) for w in words))


def count_of(c: Column, words) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(c, F.lit(w)).cast("int")
    return total


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(T.text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(T.text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def is_http(url: Column) -> Column:
    return T.text(url).rlike(r"(?i)^https?://[^/?#]")


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(T.text(c)), "[^a-z0-9]", "")


def task_text(query_context: Column, goal: Column, signals: Column) -> Column:
    return F.lower(F.concat_ws(" ", query_context, goal, F.array_join(signals, " ")))


def topic(task: Column) -> Column:
    found = F.lit("general")
    for name, words in reversed(TOPICS):
        found = F.when(has_any(task, words), F.lit(name)).otherwise(found)
    return found


def likely_official(company: Column, url: Column) -> Column:
    key, host = letters(company), letters(host_of(url))
    keys = F.array(key)
    for name, own in OFFICIAL_KEYS.items():
        keys = F.when(key == name, F.lit(list(own))).otherwise(keys)
    return (key != "") & F.exists(keys, lambda k: F.contains(host, k))


def stable_reference(url: Column) -> Column:
    return (host_of(url) == "arxiv.org") & F.startswith(path_of(url), F.lit("/abs/"))


def weak_domain(url: Column) -> Column:
    return has_any(host_of(url), LOW_QUALITY)


def weak_pricing(url: Column) -> Column:
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", "")).isin(*WEAK_PRICING)


def weak_technical(url: Column) -> Column:
    host = host_of(url)
    trusted = F.greatest(*((host == d) | F.endswith(host, F.lit("." + d)) for d in TRUSTED_TECHNICAL))
    return weak_domain(url) | host.isin("consensus.app", "www.consensus.app") | (F.endswith(path_of(url), F.lit(".pdf")) & ~trusted)


def weak_direct(source_type: Column, url: Column, task: Column, objective: Column, mode: Column) -> Column:
    """A page named by its address that has little to do with the objective: on a site that turns readers away, or without any of the objective's anchors in its address, where the source is a secondary one in a mode that wants better, or the task lacks the anchors too."""
    anchors = W.anchor_tokens(objective)
    place = F.regexp_replace(F.concat_ws(" ", host_of(url), path_of(url)), "[^a-z0-9]+", " ")
    within = lambda c: F.exists(anchors, lambda a: F.contains(c, a))
    secondary = mode.isin(*BROAD_MODES) & source_type.isin(*SECONDARY_TYPES)
    strange = (F.size(anchors) > 0) & ~within(place) & (secondary | ~within(F.lower(task)))
    return F.coalesce(~source_type.isin(*DIRECT_TYPES) & ~stable_reference(url) & (has_any(host_of(url), BLOCK_PRONE) | strange), F.lit(False))


def candidate_score(target_type: Column, target_name: Column, task: Column, title: Column, url: Column, snippet: Column) -> Column:
    """The rank of a search result for a task, whose text is task_text()."""
    told = F.lower(F.concat_ws(" ", T.clean(title), T.clean(url), T.clean(snippet)))
    host, where = host_of(url), F.concat(host_of(url), path_of(url))
    add = lambda c, n: F.when(c, n).otherwise(0)
    score = add((target_type == "company") & likely_official(target_name, url), 60) + add(stable_reference(url), 50) + add(F.greatest(*(F.endswith(host, F.lit(d)) for d in ACADEMIC)), 25)
    score = score - add(has_any(host, MIRRORS), 8) - add(weak_domain(url), 60) - add(has_any(host, BLOCK_PRONE), 35) - add(has_any(told, BOT_SIGNALS), 80)
    kind = topic(task)
    pricing = 10 * count_of(told, ("api", "model", "token", "pricing", "docs", "developer", "gemini-api")) + 12 * count_of(where, ("developers.", "docs.", "/docs", "ai.google.dev", "console.groq.com"))
    pricing = pricing - 10 * count_of(told, ("chatgpt", "team", "enterprise", "subscription", "consumer")) - add(weak_pricing(url), 80)
    growth = 8 * count_of(told, ("investor", "annual report", "earnings", "revenue", "quarter", "financial", "fact sheet", "sec")) - 12 * count_of(told, ("essay", "study guide", "homework", "sample"))
    technical = 6 * count_of(told, ("arxiv", "doi", "paper", "research", "documentation", "tutorial", "blog", "university")) - add(weak_technical(url), 45)
    general = 4 * count_of(told, ("official", "government", "ministry", "university", "museum", "encyclopedia", "institute"))
    return score + F.when(kind == "pricing", pricing).when(kind == "growth", growth).when(kind == "technical", technical).otherwise(general)


def is_pricing_task(source_type: Column, query_context: Column, goal: Column, signals: Column) -> Column:
    return has_any(F.lower(F.concat_ws(" ", T.clean(source_type), T.clean(query_context), T.clean(goal), F.array_join(T.clean_list(signals), " "))), PRICING_WORDS)


def search_result_score(url: Column, target_name: Column, pricing: Column) -> Column:
    where = F.concat_ws(" ", host_of(url), path_of(url))
    name = F.lower(T.clean(target_name))
    score = F.when((name != "") & (name != "general research") & F.contains(where, name), 40).otherwise(0)
    score = score + F.when(pricing, 20 * count_of(where, ("pricing", "price", "docs", "console", "platform")) - 80 * count_of(where, ("community", "forum", "wikipedia", "aipricing", "reddit", "medium.com"))).otherwise(0)
    return F.when(is_http(url), score).otherwise(-100)


def url_key(url: Column) -> Column:
    """Host and path in lower case; '' for what isn't http."""
    return F.when(is_http(url), F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))).otherwise("")


def search_candidates(results: DataFrame, run: str = "run") -> DataFrame:
    """Search results (run, position, url, ...) with different address keys, the first of each; those without a key go."""
    rows = results.withColumn("__k", url_key(T.clean(F.col("url")))).filter("__k <> ''")
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(run, "__k").orderBy("position"))).filter("__r = 1").drop("__k", "__r")


def rank_candidates(results: DataFrame, score: Column, run: str = "run") -> DataFrame:
    """Results with their score and place, the best first; equal ones stay in order."""
    rows = results.withColumn("score", score)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("score"), "position")))


def task_url(url: Column, source_type: Column) -> Column:
    """An address, or 'SEARCH:' and the words to look for."""
    u = T.text(url)
    search = lambda c: F.concat(F.lit("SEARCH:"), W.distinct_words(c))
    named = F.coalesce(F.nullif(W.distinct_words(F.substr(u, F.lit(8))), F.lit("")), F.lit("research sources"))
    asked = F.trim(F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(u, r"^[^?#]*\?(?:[^#]*&)?q=([^&#]*)", 1), F.lit("+"), F.lit(" "))), F.lit("")))
    engine = has_any(host_of(u), SEARCH_ENGINES) & (asked != "")
    www = F.startswith(u, F.lit("www.")) & is_http(F.concat(F.lit("https://"), u))
    loose = (source_type == "search") | F.contains(u, F.lit(" ")) | ~F.contains(u, F.lit("."))
    return (
        F.when(u == "", "SEARCH:research sources").when(F.startswith(u, F.lit("SEARCH:")), F.concat(F.lit("SEARCH:"), named)).when(engine, search(asked)).when(is_http(u), u)
        .when(www, F.concat(F.lit("https://"), u)).when(loose, search(u)).otherwise(F.concat(F.lit("SEARCH:"), u))
    )


def question_topic(question: Column) -> Column:
    plain = W.plain_query(question)
    bare = F.regexp_replace(plain, r"(?iU)\b(company|companies|each|their|across|different)\b", " ")
    words = F.filter(W.every(bare, r"[A-Za-z0-9+.#-]+"), lambda w: ~F.lower(w).isin(*TOPIC_STOPWORDS))
    found = F.trim(F.array_join(F.slice(words, 1, 4), " "))
    for signals, name in reversed(QUESTION_TOPICS):
        found = F.when(has_any(F.lower(plain), signals), F.lit(name)).otherwise(found)
    return found


def dedupe_tasks(tasks: DataFrame) -> DataFrame:
    """Of a plan's tasks with one target, type and address the one of least priority value, the first of equals; numbered task_001 and on by priority, target and context. Keys are reduced before a plan's tasks are put in order."""
    key = ["plan", F.lower("target_name").alias("__n"), F.col("source_type").alias("__t"), F.lower("url").alias("__u")]
    whole = F.struct(*(F.col(c) for c in tasks.columns if c != "plan"))
    kept = tasks.groupBy(*key).agg(F.min_by(whole, F.struct("priority", "position")).alias("t"), F.min("position").alias("__seen")).select("plan", "t.*", "__seen")
    number = F.row_number().over(Window.partitionBy("plan").orderBy("priority", F.lower("target_name"), F.lower("query_context"), "__seen"))
    return kept.withColumn("task_id", F.concat(F.lit("task_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))).drop("__seen")


def competitor_tasks(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """(plan, company, topic): what a plan (plan, companies, questions) lacks. A company's topics are taken in order; one that shares a word with a task of that company, planned or just added, is covered."""
    asked = plans.select("plan", F.posexplode("companies").alias("c", "company"), F.transform("questions", question_topic).alias("topics"))
    words = F.split(task_text(F.col("query_context"), F.col("extraction_goal"), F.col("expected_signals")), r"(?U)\s+")
    planned = tasks.select("plan", F.lower("target_name").alias("__n"), F.explode(words).alias("w")).groupBy("plan", "__n").agg(F.collect_set("w").alias("have"))
    rows = asked.withColumn("__n", F.lower("company")).join(planned, ["plan", "__n"], "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    start = F.struct(F.col("have").alias("have"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, name: Column) -> Column:
        own = F.split(F.lower(name), r"(?U)\s+")
        new = (name != "") & ~F.arrays_overlap(s["have"], own)
        more = F.concat(s["have"], F.split(F.lower(F.concat_ws(" ", F.col("company"), name, F.lit("extract"), name)), r"(?U)\s+"))
        return F.struct(F.when(new, more).otherwise(s["have"]).alias("have"), F.when(new, F.concat(s["out"], F.array(name))).otherwise(s["out"]).alias("out"))

    return rows.withColumn("out", F.aggregate("topics", start, step, lambda s: s["out"])).select("plan", "company", "c", F.posexplode("out").alias("n", "topic")).select("plan", "company", "topic", "c", "n")
