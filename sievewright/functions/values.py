"""Values as they come, made what they should be: numbers, members of a list, metadata, settings."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StructType

from . import text as T

#: The modes of research, the forms of an answer, the kinds of a target; the first is the default.
MODES = ("knowledge_research", "competitor_intel", "technical_deep_dive", "market_research")
FORMATS = ("summary", "comparison_table", "deep_dive", "report")
TARGETS = ("discovery", "company")
_DIGITS = "[0-9]+(?:_[0-9]+)*"
_PLAIN = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(T.text(c), r"(?U)^\s+|\s+$", "")


def to_long(c: Column, default: int) -> Column:
    """The whole number that a text is, with white space around it or single underscores between digits; the default for anything else, null and numbers beyond 64 bits too."""
    value = _trimmed(c)
    number = F.when(value.rlike(rf"^[+-]?{_DIGITS}$"), F.replace(value, F.lit("_")).try_cast("long"))
    return F.coalesce(number, F.lit(default).cast("long"))


def to_double(c: Column, default: float) -> Column:
    """The number that a text is, with an exponent or not, infinite or not a number; the default for anything else and for null."""
    value = _trimmed(c)
    form = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$|(?i)^[+-]?(?:inf|infinity|nan)$"
    plain = F.regexp_replace(F.replace(value, F.lit("_")), "^[+-](?i)nan$", "NaN")
    return F.coalesce(F.when(value.rlike(form), plain.try_cast("double")), F.lit(float(default)))


def choice(c: Column, allowed: tuple[str, ...], lower: bool = False) -> Column:
    """A member of a list, the first where the value is none."""
    value = F.lower(T.clean(c)) if lower else T.clean(c)
    return F.when(value.isin(*allowed), value).otherwise(allowed[0])


def clean_metadata(df: DataFrame) -> DataFrame:
    """Every column a plain value: truth values and binary numbers stay, all else becomes clean text, null the empty one, nested values JSON."""

    def plain(f):
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, _PLAIN):
            return c
        return T.clean(F.to_json(c) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else c).alias(f.name)

    return df.select(*(plain(f) for f in df.schema.fields))


def override(name: str, current, default, stated: Mapping[str, str] | None = None):
    """A setting of the environment, or of another mapping, which counts only while the argument is its default and the setting can be read as one of its kind."""
    value = (os.environ if stated is None else stated).get(name) or ""
    if current != default or not value.strip():
        return current
    if isinstance(default, bool):
        return value.strip().lower() not in ("0", "false", "no", "off")
    try:
        return type(default)(value) if isinstance(default, (int, float)) else " ".join(value.split())
    except ValueError:
        return current
