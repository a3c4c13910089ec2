"""Term lists of questions, objectives and reports: Columns in, arrays out, in order of first occurrence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, clean, distinct_ignoring_case, text

# Fixed values.
QUERY_STOPWORDS = ("and", "are", "for", "from", "how", "the", "what", "with")
OBJECTIVE_STOPWORDS = ("a", "an", "and", "architecture", "architectures", "based", "compare", "different", "for", "from", "how", "in", "is", "of", "on", "research", "the", "to", "what", "with")
REPORT_STOPWORDS = (
    "a", "an", "and", "are", "as", "be", "by", "can", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "their", "to", "what", "when", "where", "which", "with",
)
SOURCE_STOPWORDS = ("and", "are", "for", "from", "how", "into", "compare", "comparison", "different", "research", "source", "sources", "the", "what", "which", "with")
WORD_STOPWORDS = ("a", "an", "and", "for", "of", "the", "to", "what", "which")
NAMED_PHRASES = ("multiheadattention", "multi-head", "self-attention", "vision transformer", "scaled dot", "cross-attention")
GENERIC_WORDS = (
    "architecture", "architectures", "benchmark", "benchmarks", "compare", "comparison", "culture", "cultures", "different", "effect", "effects", "explain", "history", "impact", "major",
    "mechanism", "mechanisms", "model", "models", "overview", "performance", "research", "system", "systems", "technical",
)
#: Wordings that a search doesn't need, and what takes their place.
WORDINGS = (
    (r"\b(pricing models of|pricing tiers of|discounts and promotions of)\b", " "), (r"\b(what are|what is|how does|how do|are there any|can i get)\b", " "),
    (r"\bemployee counts count\b", "employee count"), (r"\brevenue growth rates rate\b", "revenue growth rate"),
)
WORD = r"[A-Za-z0-9_+#.-]+"
NAME = r"[A-Za-z][A-Za-z0-9_+.-]{2,}"


def every(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def without(words: Column, stopwords: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*stopwords))


def query_tokens(c: Column) -> Column:
    words = F.transform(every(clean(c), WORD), F.lower)
    return F.array_distinct(F.filter(without(words, QUERY_STOPWORDS), lambda w: F.length(w) > 2))


def query_keywords(c: Column, limit: int = 10) -> Column:
    """The words of a question as they stand, without outer points."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", "")
    kept = F.filter(every(clean(c), WORD), lambda w: (F.length(bare(w)) > 2) & ~bare(w).isin(*OBJECTIVE_STOPWORDS))
    return F.slice(F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", ""))), 1, max(1, limit))


def without_marks(c: Column) -> Column:
    """Text without Markdown marks and citations."""
    bare = F.regexp_replace(F.regexp_replace(text(c), r"`([^`]*)`", "$1"), r"[*_#|]+", " ")
    return clean(F.regexp_replace(bare, r"\[\d+\]", ""))


def plain_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, "[‑–]", "-")


def detail_terms(c: Column) -> Column:
    return F.array_distinct(F.transform(without(every(without_marks(c), NAME), REPORT_STOPWORDS), F.lower))


def technical_terms(c: Column) -> Column:
    """Names of three characters or more, then hyphened words, each also without its hyphens."""

    def of(value: Column) -> Column:
        hyphened = F.transform(every(value, r"(?U)\b[A-Za-z][A-Za-z0-9_+.-]*(?:-[A-Za-z0-9_+.-]+)+\b"), F.lower)
        both = F.flatten(F.transform(hyphened, lambda p: F.array(p, F.replace(p, F.lit("-"), F.lit("")))))
        return F.array_distinct(F.concat(F.transform(every(value, NAME), F.lower), both))

    return bind(plain_hyphens(without_marks(c)), of)


def named_terms(c: Column) -> Column:
    """Capitalised names and abbreviations, then the fixed phrases that occur."""
    names = F.transform(without(every(clean(c), r"(?U)\b[A-Z][A-Za-z0-9_+.-]{2,}\b|\b[A-Z]{2,}\b"), REPORT_STOPWORDS), F.lower)
    lower = F.lower(clean(c))
    phrases = F.filter(F.array(*(F.when(F.contains(lower, F.lit(p)), F.lit(p)) for p in NAMED_PHRASES)), lambda p: p.isNotNull())
    return F.array_distinct(F.concat(names, phrases))


def anchor_tokens(c: Column, most: int = 6) -> Column:
    """The words that an objective is about."""
    words = F.transform(every(F.lower(text(c)), r"[A-Za-z][A-Za-z0-9+#.-]*"), lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))), 1, most)


def plain_query(c: Column) -> Column:
    c = text(c)
    for pattern, put in WORDINGS:
        c = F.regexp_replace(c, f"(?iU){pattern}", put)
    return c


def distinct_words(c: Column) -> Column:
    """A search's words, each once whatever its case, without stopwords."""
    return F.array_join(distinct_ignoring_case(without(every(plain_query(c), r"[A-Za-z0-9+.#-]+"), WORD_STOPWORDS)), " ")


def source_terms(c: Column) -> Column:
    words = F.transform(every(clean(c), "[A-Za-z0-9_]+"), F.lower)
    return F.array_distinct(F.filter(without(words, SOURCE_STOPWORDS), lambda w: F.length(w) > 2))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; 0 where one is empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))
