"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns, which become one marked string for each conversation.

A fingerprint is the SHA-256 of the sorted nested field paths ('messages[].role') that a record fills, over all elements
of its arrays; fields that no layout knows don't count. Every record has its own, computed by SQL functions, so that one
table, or one column of JSON, may mix layouts. LAYOUTS maps sets of field paths to the expressions that give canonical
turns (turn, role, text); a record that fills only some fields of a layout has that layout, the first one of LAYOUTS
where several fit.

A turn reads '### role: text</turn>\\n'. Inside roles and texts the characters of ESCAPES stand as two characters, so
that the marks never occur there; unescape() restores them. The loss mask is held twice: loss_turns has a flag for
each turn, loss_spans the code point ranges of the masked (escaped) texts.

Defined cases: null role or text counts as ''; null turn comes first; turns with equal numbers are ordered by role,
then text; repeated rows stay; a conversation with null id is one conversation; a record that fills fields of several
layouts, or none, has no mapping: canonical() gives it one row of null turn, role and text with the whole record as JSON in
`unmapped`, and format_chat() leaves it out. In a table of turns a row of nulls alone is an empty turn. A table whose
fields make no layout raises; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes, in the order in which they are made; undone in reverse order.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLES = ("assistant",)
TURN = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _chain(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _chain(c, ESCAPES)


def unescape(c: Column) -> Column:
    return _chain(c, [(b, a) for a, b in reversed(ESCAPES)])


# -- fingerprints -----------------------------------------------------------------------------------------------------


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted nested field paths of a schema; arrays add []."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _pair(user: str, answer: str, extra: str | None = None) -> str:
    first = f"concat_ws('\\n', {user}, nullif({extra}, ''))" if extra else f"coalesce({user}, '')"
    return f"array(named_struct('turn', 0L, 'role', 'user', 'text', {first}), named_struct('turn', 1L, 'role', 'assistant', 'text', coalesce({answer}, '')))"


def _listed(array: str, role: str, text: str) -> str:
    names = "CASE {r} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce({r}, '') END".format(r=f"m.{role}")
    return f"transform({array}, (m, i) -> named_struct('turn', cast(i AS BIGINT), 'role', {names}, 'text', coalesce(m.{text}, '')))"


#: Layouts: the field paths that tell it, and the SQL expression of its canonical turns. 'rows' has a row for each turn.
LAYOUTS = {
    "rows": (["role", "text", "turn"], "array(named_struct('turn', cast(turn AS BIGINT), 'role', coalesce(role, ''), 'text', coalesce(text, '')))"),
    "prompt": (["prompt", "response"], _pair("prompt", "response")),
    "completion": (["completion", "prompt"], _pair("prompt", "completion")),
    "instruction": (["instruction", "output"], _pair("instruction", "output")),
    "instruction with input": (["input", "instruction", "output"], _pair("instruction", "output", "input")),
    "messages": (["messages[].content", "messages[].role"], _listed("messages", "role", "content")),
    "shared conversation": (["conversations[].from", "conversations[].value"], _listed("conversations", "from", "value")),
}
KNOWN = sorted({p for paths, _ in LAYOUTS.values() for p in paths})


def layouts_of(schema: T.StructType, id_col: str) -> dict[str, list[str]]:
    """The layouts whose fields a schema has whole, with these fields. An array's path needs elements that are objects."""
    have = {p for p in paths_of(schema) if p != id_col}
    return {name: paths for name, (paths, _) in LAYOUTS.items() if set(paths) <= have}


def by_fingerprint(layouts: dict[str, list[str]]) -> dict[str, str]:
    """Fingerprints of all that a record of each layout may fill, and the layout's name."""
    found: dict[str, str] = {}
    for name, paths in layouts.items():
        for bits in range(0 if name == "rows" else 1, 2 ** len(paths)):
            found.setdefault(fingerprint([p for k, p in enumerate(paths) if bits >> k & 1]), name)
    return found


def filled(paths: list[str]) -> Column:
    """The fingerprint of a row: of those of these paths that it fills."""

    def has(path: str) -> Column:
        if "[]." not in path:
            return F.col(f"`{path}`").isNotNull()
        array, field = path.split("[].")
        return F.coalesce(F.exists(F.col(f"`{array}`"), lambda m: m[field].isNotNull()), F.lit(False))

    return F.sha2(F.array_join(F.array(*(F.when(has(p), F.lit(p)) for p in sorted(paths))), "\n"), 256)


def canonical(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, role, text, unmapped), a row for each turn; each record by the mapping that its own fingerprint selects."""
    layouts = layouts_of(df.schema, id_col)
    if not layouts:
        raise ValueError(f"no mapping for the fields {sorted(paths_of(df.schema))}")
    names = by_fingerprint(layouts)
    known = sorted({p for paths in layouts.values() for p in paths})
    chosen = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("__print"))
    fields = list(dict.fromkeys(p.split("[]")[0] for p in known))
    told = df.select(F.col(id_col).alias("__id"), *(F.col(f"`{f}`") for f in fields), filled(known).alias("__print"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("__raw"))
    return _turns(told.withColumn("__layout", chosen), layouts, id_col)


def _turns(told: DataFrame, layouts: dict[str, list[str]], id_col: str) -> DataFrame:
    turns = F.lit(None).cast(T.ArrayType(TURN))
    for name in layouts:
        turns = F.when(F.col("__layout") == name, F.expr(LAYOUTS[name][1])).otherwise(turns)
    raw = F.when(F.col("__layout").isNull(), F.coalesce("__raw", F.lit("null")))
    return told.select(F.col("__id"), raw.alias("unmapped"), F.inline_outer(turns)).select(F.col("__id").alias(id_col), "turn", "role", "text", "unmapped")


#: The fields of all layouts but 'rows', as a schema for JSON records.
JSON_FIELDS = (
    "prompt STRING, response STRING, completion STRING, instruction STRING, input STRING, output STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>, "
    "conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>"
)


def canonical_json(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, role, text, unmapped) of heterogeneous JSON records, each by the mapping that its own fingerprint selects."""
    told = df.select(F.col(id_col).alias("__id"), F.col(json_col).alias("__raw"), F.from_json(F.col(json_col), JSON_FIELDS).alias("__r")).select("__id", "__raw", "__r.*")
    layouts = {name: paths for name, (paths, _) in LAYOUTS.items() if name != "rows"}
    names = by_fingerprint(layouts)
    chosen = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("__print"))
    told = told.withColumn("__print", filled([p for p in KNOWN if p not in LAYOUTS["rows"][0]])).withColumn("__layout", chosen)
    return _turns(told, layouts, id_col)


# -- formatting -------------------------------------------------------------------------------------------------------


def format_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, loss_turns, loss_spans) of canonical turns. Each turn is formatted before the shuffle; a conversation is one string in the end, so that its pieces have to meet, and nothing else does."""
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE))
    made = turns.select(
        F.col(id_col).alias("__id"),
        F.struct(
            "turn", "role", "text", piece.alias("piece"), F.col("role").isin(*LOSS_ROLES).alias("loss"),
            F.length(piece).cast("long").alias("n"), F.length(escape(F.col("text"))).cast("long").alias("body"),
        ).alias("t"),
    )
    held = made.groupBy("__id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    body = F.transform("t", lambda x: F.struct(x["loss"].alias("loss"), x["n"].alias("n"), x["body"].alias("body")))
    # running ends of the masked texts: pairs of strings are avoided, only three numbers a turn are folded
    spans = F.aggregate(
        body,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["n"]).alias("at"),
            F.when(
                x["loss"],
                F.concat(s["out"], F.array(F.struct((s["at"] + x["n"] - len(CLOSE) - x["body"]).alias("start"), (s["at"] + x["n"] - len(CLOSE)).alias("end")))),
            ).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    return held.select(
        F.col("__id").alias(id_col), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.transform("t", lambda x: x["loss"]).alias("loss_turns"), spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text)."""
    pieces = F.split(formatted, CLOSE)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    head = F.transform(whole, lambda p: F.substring_index(p, MIDDLE, 1))
    return F.transform(
        F.arrays_zip(whole.alias("p"), head.alias("h")),
        lambda z: F.struct(
            unescape(F.substr(z["h"], F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(z["p"], F.length(z["h"]) + len(MIDDLE) + 1)).alias("text"),
        ),
    )


def format_chat(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    return format_turns(canonical(df, id_col).filter("unmapped IS NULL"), id_col)
