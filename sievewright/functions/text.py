"""Text and markup functions: Columns in, Columns out, all inside the JVM. Null counts as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RETRIEVAL_STOPWORDS = ("and", "are", "for", "from", "how", "the", "what", "when", "where", "which", "with")
NOISE = (
    "accept all|cookie|privacy policy|terms of use|all rights reserved|subscribe|newsletter|sign in|sign up|log in|skip to|share this|"
    "advertisement|sponsored|enable javascript|table of contents|download pdf|view pdf|back to top"
)
NAVIGATION = ("home ", "menu ", "navigation ", "search ")
BLOCKED = (
    "access denied", "attention required", "bot detection", "captcha", "cf-chl", "checking if the site connection is secure", "checking your browser", "cloudflare",
    "enable javascript and cookies", "error 1005", "error 1015", "forbidden", "http 403", "http 429", "http 503", "just a moment", "performance and security by cloudflare",
    "please verify you are a human", "rate limited", "request blocked", "unusual traffic", "verify you are human",
)
NOT_FOUND = ("404", "page not found", "does not exist", "no article")
#: The two parts 'formulation' and 'torch.' are one alternative, as in the behaviour to match.
SIGNAL = (
    r"(?i)(\\(?:frac|sum|sqrt|top|operatorname)|\b(?:equation|formula|softmax|sqrt|formulationtorch\.|tf\.|keras\.|class\s+\w+|\w+\([^)]*\)|"
    r"benchmark|accuracy|bleu|glue|imagenet|top-1|f1|auc|latency|tokens?/sec)\b|[A-Za-z0-9_{}()\\]+\s*=\s*[^=\n]{4,})"
)
HEADING = (
    r"(?i)^\s*(?:#{1,6}\s+|\d+(?:\.\d+)*[.)]\s+)?(abstract|introduction|background|related work|method|methods|methodology|model|architecture|approach|algorithm|"
    r"implementation|experiments?|evaluation|results?|discussion|analysis|limitations?|conclusion|references?|appendix)\b"
)
IDENTITY_STOPWORDS = (
    "about", "across", "and", "are", "compare", "comparison", "different", "does", "each", "explain", "for", "from", "have", "how", "into", "its", "main", "of", "the", "their", "these", "this",
    "to", "what", "which", "with",
)
FORMULA_SIGNAL = (r"(?i)\\(?:frac|sum|sqrt|top|operatorname)|\b(?:softmax|sqrt)\s*\(", r"[A-Za-z0-9_{}()\\]+\s*=\s*[^=\n]{4,}")
API_SIGNAL = r"\b(?:torch\.|tf\.|keras\.)[A-Za-z0-9_.]+"
NUMBERED_HEADING = r"^\d+(?:\.\d+)*[.)]\s+[A-Z][A-Za-z0-9 ,:;()/_-]{3,}$"
#: What a query, and a hit's own text, must show for the hit's neighbours to be added.
FORMULA_CONTEXT = (
    r"(?i)\b(attention\s*\(|multihead|multi-head|scaled\s+dot|dot-product|softmax|sqrt|qk|k\^?t|concat|equation|formula|"
    r"wq|wk|wv|wo|w\^q|w\^k|w\^v|w\^o)\b"
)
BENCHMARK_TERMS = ("benchmark", "accuracy", "bleu", "glue", "imagenet", "top-1", "f1", "auc")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once for each row, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed. What is a single space already isn't matched."""
    return F.trim(F.regexp_replace(text(c), r"(?U) \s+|[^\S ]\s*", " "))


def clean_list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean), lambda x: x != "")


def distinct_ignoring_case(c: Column) -> Column:
    """The first of values that differ in case only, in order."""
    return bind(F.transform(c, F.lower), lambda seen: F.filter(c, lambda x, i: F.array_position(seen, F.lower(x)) == i + 1))


#: A character reference as browsers read it: numbers in either base, or a name, with or without its semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: One that ends in its semicolon.
CLOSED = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[^\t\n\f <&#;]{1,32});"
_LOST = "\ufffd"


def _code(m: Column) -> Column:
    """The number of a numeric reference; one beyond eight digits is as good as any beyond Unicode."""
    digits = lambda c, pattern: F.regexp_replace(F.regexp_extract(c, pattern, 1), "^0+(?=.)", "")
    hexed, plain = digits(m, "^&#[xX]([0-9a-fA-F]+)"), digits(m, "^&#([0-9]+)")
    return F.when(hexed != "", F.when(F.length(hexed) > 8, 0x110000).otherwise(F.conv(hexed, 16, 10).try_cast("long"))).otherwise(F.when(F.length(plain) > 8, 0x110000).otherwise(plain.try_cast("long")))


def character(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _character(n: Column) -> Column:
    """The character of a number: what can't be one is lost, control characters mean those of Windows-1252 or nothing."""
    windows = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)]
    nothing = n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
    return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), _LOST).when(n.between(0x80, 0x9F), F.get(F.lit(windows), (n - 0x80).cast("int"))).when(nothing, "").otherwise(character(n))


def _named(m: Column, closed: bool) -> Column:
    """What a named reference stands for: its own name, else (unless closed) the longest name that it begins with, else itself. The names are those of HTML 5, from Python's library."""
    from html.entities import html5

    table = lambda names: F.map_from_arrays(F.lit(names), F.lit([html5[x] for x in names]))
    bare = sorted((x for x in html5 if not x.endswith(";")), key=lambda x: (-len(x), x))
    name = F.substring(m, 2, 40)
    if closed:
        return F.coalesce(F.try_element_at(table(sorted(html5)), name), m)
    starts = F.filter(F.lit(bare), lambda b: F.startswith(name, b))
    begun = bind(F.get(starts, F.lit(0)), lambda b: F.when(b.isNotNull(), F.concat(F.element_at(table(bare), b), F.substr(name, F.length(b) + 1))).otherwise(m))
    return F.coalesce(F.try_element_at(table(sorted(html5)), name), begun)


def unescape(c: Column, closed: bool = False) -> Column:
    """Every character reference, named or numbered, in one pass: a text is cut at its references, and each is put as what it stands for. closed: one without its semicolon is text."""
    reference = CLOSED if closed else REFERENCE

    def of(x: Column) -> Column:
        between, found = F.split(x, reference, -1), F.regexp_extract_all(x, F.lit(reference), F.lit(0))
        put = F.transform(found, lambda m: F.when(F.startswith(m, F.lit("&#")), _character(_code(m))).otherwise(_named(m, closed)))
        return F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.when(F.contains(c, F.lit("&")), bind(c, of)).otherwise(c)


def html_text(c: Column, closed: bool = False) -> Column:
    """Markup to lines of text: one for each block, cells parted by ' | ', blank lines dropped. closed: as in unescape()."""
    c = F.regexp_replace(text(c), r"(?is)<(script|style).*?</\1>", "\n")
    c = F.regexp_replace(c, r"(?i)</(p|div|section|article|header|footer|main|nav|li|ul|ol|h[1-6]|tr)>|<br\s*/?>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</t[dh]>", " | "), r"<[^>]+>", " ")
    return F.array_join(clean_list(F.split(unescape(c, closed), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")), "\n")


def html_title(c: Column) -> Column:
    return clean(F.regexp_extract(text(c), r"(?is)<title[^>]*>(.*?)</title>", 1))


def table_rows(c: Column) -> Column:
    """One line for each different table row, its cells parted by ' | '."""
    rows = F.regexp_extract_all(text(c), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.array_join(clean_list(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: unescape(F.regexp_replace(x, "<[^>]+>", " ")))), " | "))
    return F.array_distinct(F.filter(cells, lambda x: x != ""))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text; white space needs no cleaning before, as no token has any."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9_]+)"), F.lit(1))


def clean_count(c: Column) -> Column:
    """The tokens of a cleaned text, which single spaces part."""
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def token_count(c: Column) -> Column:
    return bind(clean(c), clean_count)


def has_signal(c: Column) -> Column:
    """Whether SIGNAL is met; its last alternative, an equation, is slow and only tried where there is a sign of equality."""
    return c.rlike(SIGNAL.rsplit("|", 1)[0] + ")") | (F.contains(c, F.lit("=")) & c.rlike(SIGNAL))


def relevance_terms(c: Column, stopwords: tuple[str, ...] = RETRIEVAL_STOPWORDS) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*stopwords)))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(key: Column, url: Column, index: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.sha2(F.concat_ws(":", key, url, index.cast("string")), 256))


def parent_id(key: Column, url: Column, index: Column, content: Column) -> Column:
    return F.concat(F.lit("parent-"), F.substring(F.sha2(F.concat_ws(":", key, url, index.cast("string"), content), 256), 1, 16))


def blocked(c: Column) -> Column:
    lower = F.lower(clean(c))
    found = F.lit(False)
    for term in BLOCKED:
        found = found | F.contains(lower, F.lit(term))
    return found


def not_found(c: Column) -> Column:
    lower = F.lower(clean(c))
    found = F.lit(False)
    for term in NOT_FOUND:
        found = found | F.contains(lower, F.lit(term))
    return found


def signals(c: Column) -> dict[str, Column]:
    lower = F.lower(text(c))
    bench = F.lit(False)
    for term in BENCHMARK_TERMS:
        bench = bench | F.contains(lower, F.lit(term))
    return {
        "has_formula_signal": text(c).rlike(FORMULA_SIGNAL[0]) | (F.contains(text(c), F.lit("=")) & text(c).rlike(FORMULA_SIGNAL[1])),
        "has_api_signal": text(c).rlike(API_SIGNAL),
        "has_benchmark_signal": bench,
    }


def is_heading(c: Column) -> Column:
    return (c != "") & (F.length(c) <= 140) & (F.startswith(c, F.lit("#")) | c.rlike(HEADING) | c.rlike(NUMBERED_HEADING))


def strip_thinking(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"(?is)<think>.*?</think>", ""))


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def citations(c: Column) -> Column:
    """Numbers cited as [n], [ n ], [n, m] or in corner brackets, in order."""
    marks = F.regexp_extract_all(F.regexp_replace(text(c), r"【\s*(\d+)[^】]*】", "[$1]"), F.lit(r"\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]"), F.lit(1))
    return F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*"))), lambda x: x.cast("int"))


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def keep_ends(c: Column, most: int, mark: str = "\n...\n") -> Column:
    """The first and last parts of a text that is longer than `most`."""
    side = (most - len(mark)) // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, side), F.lit(mark), F.right(c, F.lit(side))))


def singular(t: Column) -> Column:
    return (
        F.when(F.endswith(t, F.lit("ies")) & (F.length(t) > 4), F.concat(F.substr(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")) & (F.length(t) > 3), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    )


def identity_terms(c: Column) -> Column:
    """Sorted canonical words of an objective: lower-cased, letters and digits, singular, longer than two, no stopwords."""
    words = F.transform(F.split(F.lower(clean(c)), " "), lambda w: singular(F.regexp_replace(F.regexp_replace(w, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*IDENTITY_STOPWORDS))))


def objective_key(objective: Column, companies: Column | None = None) -> Column:
    """Hash of the sorted companies and the first twelve other terms."""
    names = F.array_sort(F.array_distinct(F.transform(clean_list(companies), lambda x: singular(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "_"))))) if companies is not None else F.array().cast("array<string>")
    own = F.flatten(F.transform(names, lambda x: F.split(x, "_")))
    parts = F.concat(names, F.slice(F.array_except(identity_terms(objective), own), 1, 12))
    return F.sha2(F.when(F.size(parts) == 0, F.lit("research")).otherwise(F.array_join(parts, ":")), 256)
