"""URL filters: prefix rules, and exact list membership by a cascade of Bloom filters.

Level 1 of the cascade holds the listed keys; level 2 those keys of the corpus's whole key universe that level 1 takes
in wrongly; level 3 the listed keys that level 2 takes in wrongly, and so on, until a level makes no error. The first
level that says no decides: at an odd level the key isn't listed, at an even level it is. For every key of the universe
the answer is exact, and no row is joined.

Filters are built by SQL aggregates: bitmap_construct_agg makes a bitmap of 32,768 bits for each bucket of positions.
A level travels as one binary literal. Keys are dealt to shards by their hash, as many as it takes for each shard's
cascade to stay near MAX_BYTES whatever the list's size. With one shard, the usual case, the answer is an expression in
the plan of the rows. With more, the rows are written once by shard, then answered shard by shard, each by its own
cascade, so that only one of them travels at a time; no rows are joined in either case.

Defined cases: null url, or one without '://', has an empty host and path, fits no rule and is not listed; an empty
list lists nothing; repeated rows are judged alike; a rule's host is matched with A-Z lower-cased.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitioned, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_BYTES = 32 << 20
BUCKET = 32_768
HASHES = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits. Equal lengths: the first in order of text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        cut = text.index("/")
        own = text[:cut].translate(str.maketrans(UPPER, LOWER))
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(text[cut:]))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


# -- cascade ----------------------------------------------------------------------------------------------------------


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """HASHES bit positions of a key by double hashing, differently at each level."""
    a, b = F.xxhash64(F.lit(level), key), F.xxhash64(key, F.lit(level + 1000))
    step = b.bitwiseOR(F.lit(1))
    return [F.pmod((F.shiftright(a, 2) + i * F.shiftright(step, 4)).cast("long"), F.lit(bits).cast("long")) for i in range(HASHES)]


def contains(key: Column, level: int, bits: int, held: bytes) -> Column:
    """Whether a Bloom filter made by level() takes a key in."""
    found = F.lit(True)
    data = F.lit(bytearray(held))
    for at in _positions(key, level, bits):
        byte = F.conv(F.hex(F.substring(data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.call_function("getbit", byte, (at % 8).cast("int")) == 1)
    return found


class Cascade:
    """Levels as (bits, bytes); contains() is an expression."""

    def __init__(self, levels: list[tuple[int, bytes]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(~contains(key, k, *self.levels[k]), F.lit(k % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    def size(self) -> int:
        return sum(len(b) for _, b in self.levels)


def _bits(n: int, error: float) -> int:
    return max(BUCKET, math.ceil(-HASHES * n / math.log(1 - error ** (1 / HASHES)) / BUCKET) * BUCKET)


def level(keys: DataFrame, bits: int, level: int) -> tuple[int, bytes]:
    """A Bloom filter of keys (column k) as (bits, bytes)."""
    at = keys.select(F.explode(F.array(*_positions(F.col("k"), level, bits))).alias("p")).select(F.floor(F.col("p") / BUCKET).alias("b"), (F.col("p") % BUCKET).alias("p"))
    held = bytearray(bits // 8)
    for row in at.groupBy("b").agg(F.bitmap_construct_agg(F.col("p")).alias("m")).toLocalIterator():  # bits / 32,768 rows of 4 KB
        held[row.b * BUCKET // 8 : (row.b + 1) * BUCKET // 8] = row.m
    return bits, bytes(held)


def prefilter(keys: DataFrame, n: int, most: int = MAX_BYTES) -> tuple[int, bytes]:
    """One Bloom filter of n keys in at most `most` bytes: the more keys, the more others it takes in."""
    return level(keys, min(_bits(n, 0.01), most * 8 // BUCKET * BUCKET), 0)


def _error(n: int, others: int) -> float:
    """Level 1 admits about as many others as there are keys."""
    return min(0.5, max(1e-6, n / max(1, others) / 2))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards))


def universe_of(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """(k, l): the different keys of a universe, and whether each is listed. Keys listed but outside the universe are left out, since nobody asks for them. keys, listed: a column k each."""
    both = keys.select("k", F.lit(0).alias("l")).unionByName(listed.select("k", F.lit(1).alias("l"))).filter(F.col("k").isNotNull())
    return staged(both.groupBy("k").agg(F.max("l").alias("l"), F.min("l").alias("in_u")).filter("in_u = 0").select("k", "l"), "urls-universe")


def _cascade(u: DataFrame, n_in: int, n_out: int) -> Cascade:
    levels: list[tuple[int, bytes]] = []
    left, n, side = {1: u.filter("l = 1"), 0: u.filter("l = 0")}, {1: n_in, 0: n_out}, 1
    while n[side]:
        levels.append(level(left[side], _bits(n[side], 0.1 if levels else _error(n[side], n[1 - side])), len(levels)))
        left[1 - side] = staged(left[1 - side].filter(contains(F.col("k"), len(levels) - 1, *levels[-1])), "urls-wrong")
        n[1 - side] = left[1 - side].count()
        side = 1 - side
    return Cascade(levels)


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """One cascade, of whatever size. universe, listed: a column k each."""
    u = universe_of(universe, listed)
    return _cascade(u, *_counts(u))


def _counts(u: DataFrame) -> tuple[int, int]:
    r = u.agg(F.count_if(F.col("l") == 1).alias("n_in"), F.count_if(F.col("l") == 0).alias("n_out")).first()
    return r.n_in, r.n_out


def list_membership(df: DataFrame, key: Column, listed: DataFrame, most: int = MAX_BYTES, universe: DataFrame | None = None) -> DataFrame:
    """df with a boolean column __listed. universe: a column k with all keys of df, where they are known from a slimmer table."""
    keyed = df.withColumn("__k", key)
    u = universe_of(keyed.select(F.col("__k").alias("k")) if universe is None else universe, listed)
    n_in, n_out = _counts(u)
    # later levels hold about half as many keys as the first, then fewer and fewer
    size = 2 * _bits(n_in, _error(n_in, n_out)) // 8 if n_in else 0
    shards = max(1, math.ceil(size / most))
    if shards == 1:
        return keyed.withColumn("__listed", _cascade(u, n_in, n_out).contains(F.col("__k"))).drop("__k")
    shard = F.coalesce(shard_of(F.col("k"), shards), F.lit(0)).alias("__shard")
    by_shard = partitioned(u.withColumn("__shard", shard), "__shard", "urls-shards")
    rows = partitioned(keyed.withColumn("__shard", F.coalesce(shard_of(F.col("__k"), shards), F.lit(0))), "__shard", "urls-rows")
    out = None
    for s in range(shards):
        own = by_shard.filter(F.col("__shard") == s).select("k", "l")
        told = _cascade(own, *_counts(own))
        done = staged(rows.filter(F.col("__shard") == s).withColumn("__listed", told.contains(F.col("__k"))).drop("__k", "__shard"), "urls-told")
        out = done if out is None else out.unionByName(done)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed). listed: a column k of keys host || path to block where no rule fits."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    key = F.when((F.col("host") != "") | (F.col("path") != ""), F.concat("host", "path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    told = list_membership(parsed, key, listed)
    return told.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.col("__listed").alias("listed"),
    )


def junk_keys(pages: DataFrame) -> DataFrame:
    """The list that the registered query uses: keys of pages whose markup holds all of the symbol runs '***', '$$$' and '%%%'."""
    host, path = host_and_path(F.col("url"))
    bad = pages.filter(F.contains("html", F.lit("***")) & F.contains("html", F.lit("$$$")) & F.contains("html", F.lit("%%%")))
    return bad.select(host.alias("host"), path.alias("path")).filter((F.col("host") != "") | (F.col("path") != "")).select(F.concat("host", "path").alias("k"))
