"""URL functions. Bad input gives '' or itself, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean


def is_http(c: Column) -> Column:
    return c.rlike(r"(?i)^https?://[^/?#]+")


def canonical(c: Column) -> Column:
    """Lower scheme and host; no query, fragment, last-segment parameters or trailing slash. What isn't http stays."""
    pattern = r"(?is)^(https?)://([^/?#]+)([^?#]*).*$"
    scheme, host, path = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    kept = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), "/+$", "")
    return F.when(is_http(c), F.concat(F.lower(scheme), F.lit("://"), F.lower(host), kept)).otherwise(c)


def arxiv(c: Column) -> Column:
    """The one PDF address of an arXiv abstract or PDF page."""
    number = F.regexp_extract(c, r"^(https?)://arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})(?:v\d+)?(?:\.pdf)?$", 2)
    return F.when(number != "", F.concat(F.regexp_extract(c, "^(https?)", 1), F.lit("://arxiv.org/pdf/"), number)).otherwise(c)


def source(c: Column) -> Column:
    """The canonical form under which sources are compared; '' for what isn't http."""
    made = canonical(clean(c))
    return F.when(F.startswith(made, F.lit("http://")) | F.startswith(made, F.lit("https://")), arxiv(made)).otherwise(F.lit(""))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?i)^https?://([^/?#]*)", 1))


def key(c: Column) -> Column:
    """Host without www., and path: what makes two planned addresses one."""
    made = canonical(clean(c))
    return F.concat(F.regexp_replace(host(made), r"^www\.", ""), F.regexp_extract(made, r"^https?://[^/]*(.*)$", 1))


def is_pdf(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([^?#]*)", 1)).endswith(".pdf")


def sources_of(url: Column, source_url: Column, task_urls: Column) -> Column:
    """All different source addresses of a record."""
    every = F.concat(F.array(url, source_url), F.split(clean(task_urls), r"\|"))
    return F.array_distinct(F.filter(F.transform(every, source), lambda u: u != ""))


def authoritative(c: Column) -> Column:
    h = F.regexp_replace(host(c), r"^www\.", "")
    path = F.lower(F.regexp_extract(c, r"(?i)^https?://[^/?#]*([^?#]*)", 1))
    return h.isin("arxiv.org", "openreview.net", "pytorch.org", "tensorflow.org") | h.rlike(r"\.edu$|\.gov$|doi\.org$|docs\.") | path.endswith(".pdf")


def authority_score(urls: Column, title: Column, source_type: Column, quality: Column) -> Column:
    """A boost from 0 to 1 for primary sources: later rules act on what earlier ones gave."""
    u, t, kind = F.lower(urls), F.lower(clean(title)), F.lower(clean(source_type))
    s = F.when(kind.isin("arxiv", "pdf", "paper") | F.contains(u, F.lit("arxiv.org")), F.lit(1.0)).otherwise(F.lit(0.0))
    s = F.when(u.rlike(r"nature\.com|ibm\.com|\.edu|docs\.|documentation"), F.greatest(s, F.lit(0.75))).otherwise(s)
    s = F.when(kind.isin("webpage", "news"), F.greatest(s, F.lit(0.45))).otherwise(s)
    s = F.when(u.rlike(r"geeksforgeeks\.org|medium\.com|blog|erdem\.pl"), F.least(F.greatest(s, F.lit(0.35)), F.lit(0.45))).otherwise(s)
    s = F.when(F.contains(F.lower(clean(quality)), F.lit("useful")) & (s == 0), F.lit(0.55)).otherwise(s)
    return F.when(t.rlike("paper|arxiv|documentation|docs"), F.greatest(s, F.lit(0.7))).otherwise(s)


#: An address inside a text.
IN_TEXT = r"https?://[^\s\])}>\"']+"


def leaves(c: Column, kind: T.DataType) -> Column:
    """All texts inside a nested value, in the order of its schema, as an array; the schema is walked while the plan is made. Nulls are left out."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(c.isNull(), none).otherwise(F.array(c))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: leaves(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(c), lambda x: leaves(x, kind.valueType))), none)
    if isinstance(kind, T.StructType):
        return F.coalesce(F.concat(*(leaves(c.getField(f.name), f.dataType) for f in kind.fields)), none) if kind.fields else none
    return none


def extracted(texts: Column) -> Column:
    """The different source addresses in texts, in order; points and commas after an address aren't its own."""
    found = F.flatten(F.transform(texts, lambda x: F.regexp_extract_all(x, F.lit(IN_TEXT), F.lit(0))))
    return F.array_distinct(F.filter(F.transform(found, lambda u: source(F.regexp_replace(u, "[.,;:]+$", ""))), lambda u: u != ""))
