"""Near-duplicate removal: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set holds 64-bit hashes of its distinct 5-word shingles. The top bits of a hash name one of BINS bins, the
least hash of each bin is the signature, and an empty bin copies the first non-empty one of a fixed random sequence of
bins, the same for all documents. BANDS keys of BINS / BANDS bins each put documents into buckets: two documents of
similarity 0.75 miss each other in all 32 buckets with probability 5e-6.

1. Documents with equal sets are one class, for which its smallest doc_id stands from here on.
2. In each bucket one hub, the member that shares most buckets with others, is paired with the other members (a star:
   as many pairs as members). Pairs are confirmed on their full sets, confirmed links are contracted to components.
3. Members of buckets that still hold several components are joined by their shingles, by prefix filtering: shingles are
   ordered by how many members hold them, and two sets that share c of them have their first common one where at least
   c are left in either. A pair is made only where that leaves room for a link, across components, and is confirmed on
   full sets too. Shingles of one component's members alone come first in the order and join nothing, so that neither
   copies nor families of texts just below the threshold are compared pair by pair. Before the full sets of a pair meet,
   the parities of their hashes do (parity()): bits that differ stand for members that one set alone has, and a pair with
   too many of them for a link goes. So parts that a family's members share in pairs, below the threshold, don't bring
   their sets together. Nothing is estimated.

Defined cases: null or blank text has an empty set and is linked with nothing; fewer than five words are one shingle;
rows with one doc_id are one document with several texts; a row with null doc_id has a null component and is kept;
extra columns are ignored by components() and kept by deduplicate(), where a document's repeated rows leave one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, scratch, ship, staged
from .urls import contains, list_membership, prefilter

WORDS = 5
BINS = 128
BANDS = 32
SHARE, OF = 75, 100
#: Texts whose sets are held at a time.
ROWS = 512

LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_words = WordCache(xxhash.xxh3_64_intdigest, 150_000)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWERED).split() if text else []


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8."""
    parts = words(text)
    n = len(parts)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, parts), dtype=np.uint64, count=n)
    if n < WORDS:
        return mixed(np.array([(h * _ODD[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
    total = np.zeros(n - WORDS + 1, dtype=np.uint64)
    for j in range(WORDS):
        total += h[j : n - WORDS + 1 + j] * _ODD[j]
    return np.unique(mixed(total))


_STARTS = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - int(math.log2(BINS)))).astype(np.uint64)
_SHIFT = np.uint64(64 - int(math.log2(BINS)))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Densified signatures (rows x BINS) of non-empty sets."""
    values = np.zeros((len(sets), BINS), dtype=np.uint64)
    full = np.zeros((len(sets), BINS), dtype=bool)
    for r, u in enumerate(sets):
        at = np.searchsorted(u, _STARTS)
        got = u[np.minimum(at, len(u) - 1)]
        full[r] = (at < len(u)) & ((got >> _SHIFT) == np.arange(BINS, dtype=np.uint64))
        values[r] = got
    rows, bins = np.nonzero(~full)
    t = 0
    while len(rows):
        from_bin = (mixed((bins.astype(np.uint64) + np.uint64(BINS * (t + 1))) * _ODD[0]) >> _SHIFT).astype(np.int64)
        hit = full[rows, from_bin]
        values[rows[hit], bins[hit]] = values[rows[hit], from_bin[hit]]
        rows, bins = rows[~hit], bins[~hit]
        t += 1
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    per = BINS // BANDS
    grouped = values.reshape(len(values), BANDS, per)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _ODD[4]
    for j in range(per):
        total = mixed(total + grouped[:, :, j] * _ODD[j])
    return total


def parity(u: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes ends in each value of so many bits that there are four to eight places for each hash."""
    places = max(64, 1 << (4 * len(u) - 1).bit_length()) if len(u) else 64
    at = u & np.uint64(places - 1)
    out = np.zeros(places >> 6, dtype=np.uint64)
    np.bitwise_xor.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = [shingles(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        some = [u for u in sets if len(u)]
        values = signature(some) if some else np.empty((0, BINS), dtype=np.uint64)
        keys = band_keys(values).view(np.int64)
        out: list = []
        k = 0
        for u in sets:
            if not len(u):
                out.append((0, 0, 0, None))
                continue
            raw = u.tobytes()
            out.append((len(u), xxhash.xxh3_64_intdigest(raw) - 2**63, xxhash.xxh64_intdigest(raw) - 2**63, keys[k]))
            k += 1
        n, a, b, ks = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ks, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "sa", "sb", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        found = [shingles(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        held = [pa.array([f(u).view(np.int64) for u in found], pa.list_(pa.int64())) for f in (np.asarray, parity)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *held], ["id", "s", "bits"])


def linked(common: Column, na: Column, nb: Column) -> Column:
    return OF * common >= SHARE * (na + nb - common)


# -- components -------------------------------------------------------------------------------------------------------


def contract(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of edges (a, b), a != b: alternating large and small stars until nothing changes."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(down, "u")
        small = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(both.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = staged(small, "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = seen


def room(rest: Column, na: Column, nb: Column) -> Column:
    """Whether rest common shingles make a link of sets of na and nb."""
    return (OF + SHARE) * rest >= SHARE * (na + nb)


def across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of members (id, root) with different roots: all links among them, and few others."""
    each = members.join(sets, "id").select("id", "root", F.size("s").alias("n"), F.explode("s").alias("t"))
    # the order of shingles; those of one root alone, first in it, are left out
    order = each.groupBy("t").agg(F.count("*").alias("c"), F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("t", "c")
    ahead = Window.partitionBy("id").orderBy(F.desc("c"), F.desc("t"))
    left = each.join(order, "t").withColumn("rest", F.row_number().over(ahead)).filter(OF * F.col("rest") >= SHARE * F.col("n"))
    left = staged(left.select("id", "root", "n", "t", "rest"), "near-prefixes")
    # of two roots one at least isn't a shingle's main one, so that a large component's members don't meet one another
    main = left.groupBy("t", "root").agg(F.count("*").alias("c")).groupBy("t").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    left = left.join(main.filter("roots > 1").select("t", "main"), "t").withColumn("minor", F.col("root") != F.col("main"))
    left = staged(left.select("id", "root", "n", "t", "rest", "minor"), "near-postings")
    one = left.filter(room(F.col("rest"), F.col("n"), F.col("n"))).select("t", *(F.col(c).alias(f"{c}1") for c in ("id", "root", "n", "rest", "minor")))
    two = left.select("t", *(F.col(c).alias(f"{c}2") for c in ("id", "root", "n", "rest", "minor")))
    fits = (F.struct("n1", "id1") < F.struct("n2", "id2")) & (F.col("root1") != F.col("root2")) & room(F.least("rest1", "rest2"), F.col("n1"), F.col("n2"))
    met = one.filter("minor1").join(two, "t").filter(fits).unionByName(one.filter("NOT minor1").join(two.filter("minor2"), "t").filter(fits))
    return met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def _folded(bits: Column, n: Column) -> Column:
    """Parities of n words, or of twice as many, as n words."""
    return F.when(F.size(bits) <= n, bits).otherwise(F.zip_with(F.slice(bits, F.lit(1), n), F.slice(bits, n + 1, n), lambda x, y: x.bitwiseXOR(y)))


def near_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose parities leave room for a link: no link is lost, as parities never differ in more places than sets do in members."""
    own = lambda a: sets.select(F.col("id").alias(a), F.size("s").alias(f"n{a}"), F.col("bits").alias(f"bits_{a}"))
    both = pairs.join(own("b"), "b").join(own("a"), "a")
    n = F.least(F.size("bits_a"), F.size("bits_b"))
    apart = F.zip_with(_folded(F.col("bits_a"), n), _folded(F.col("bits_b"), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.coalesce(F.aggregate(apart, F.lit(0), lambda d, x: d + x), F.lit(0))
    total = F.col("na") + F.col("nb")
    return both.filter((OF + SHARE) * (total - differ) >= 2 * SHARE * total).select("a", "b")


def describe(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, sa, sb, keys), a row for each row of df."""
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_describe, "doc_id long, n_shingles long, sa long, sb long, keys array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("id").alias("a"), F.col("s").alias("s1"))
    two = sets.select(F.col("id").alias("b"), F.col("s").alias("s2"))
    both = pairs.join(two, "b").join(one, "a")  # nothing that groups by a follows, so that a hub's many pairs may be split
    common = F.size(F.array_intersect("s1", "s2"))
    return both.select("a", "b", common.alias("c"), F.size("s1").alias("na"), F.size("s2").alias("nb")).filter(linked(F.col("c"), F.col("na"), F.col("nb"))).select("a", "b")


def _fetch(df: DataFrame, ids: DataFrame, text_col: str) -> DataFrame:
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.col("doc_id").cast("string")
    # a Bloom filter keeps most other texts out of the shuffle
    texts = texts.filter(contains(key, 0, *prefilter(ids.select(F.col("id").cast("string").alias("k")), ids.count())))
    texts = texts.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return staged(texts.mapInArrow(_sets, "id long, s array<long>, bits array<long>"), "near-sets")


def components(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of df."""
    slim = staged(describe(df, text_col), "near-signatures")
    some = slim.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = staged(some.groupBy("n_shingles", "sa", "sb").agg(F.min("doc_id").alias("id"), F.min_by("keys", "doc_id").alias("keys")), "near-classes")

    banded = reps.select("id", F.explode("keys").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(banded.join(sizes, "key"), "near-buckets")
    # buckets with the same members need one look: one key stands for all of them
    marks = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("m1"), F.min("id").alias("m2"))
    keys = marks.groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    degree = members.groupBy("id").agg(F.sum("n").alias("d"))
    members = staged(members.join(keys, "key", "left_semi").join(degree, "id"), "near-members")
    hubs = members.groupBy("key").agg(F.max_by("id", F.struct(F.col("d"), -F.col("id"))).alias("hub"))
    stars = members.join(hubs, "key").filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    n = reps.select("id", "n_shingles")
    stars = stars.join(n.select(F.col("id").alias("a"), F.col("n_shingles").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb")), "b")
    pairs = staged(stars.filter("3 * greatest(na, nb) <= 4 * least(na, nb)").select("a", "b"), "near-pairs")

    asked = staged(members.select("id").distinct(), "near-asked")
    sets = _fetch(df, asked, text_col)
    links = staged(_confirm(pairs, sets), "near-links")
    roots = staged(contract(links), "near-roots")

    # what the stars left apart
    placed = members.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed_keys = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("key")
    apart = staged(placed.join(mixed_keys, "key", "left_semi").select("id", "root").distinct(), "near-apart")
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    close = staged(near_enough(across(apart, sets).join(done, ["a", "b"], "left_anti"), sets), "near-close")
    late = staged(_confirm(close, sets), "near-late")
    if not late.isEmpty():
        roots = staged(contract(links.unionByName(late)), "near-roots")

    classes = reps.select("n_shingles", "sa", "sb", "id").join(roots, "id", "left").select("n_shingles", "sa", "sb", F.coalesce("root", "id").alias("__c"))
    out = slim.select("doc_id", "n_shingles", "sa", "sb").join(classes, ["n_shingles", "sa", "sb"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("__c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with one document of each component, that with the smallest doc_id."""
    with scratch(df.sparkSession) as drop:
        found = components(df, text_col)
    told = staged(found, "near-components")
    drop()  # sets and signatures are as large as the texts
    key = F.col("doc_id").cast("string")
    gone = told.filter(~F.col("kept")).select(key.alias("k")).distinct()
    # a filter cascade over these ids is exact for them, so that no text is shuffled
    marked = list_membership(df, F.col("doc_id").cast("long").cast("string"), gone, universe=told.select(key.alias("k")))
    left = marked.filter(~F.col("__listed")).select(*df.columns)
    again = told.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    single = left.join(again, "doc_id", "left_anti").select(*df.columns)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(text_col), F.col(text_col)))
    first = left.join(again, "doc_id", "left_semi").withColumn("__r", order).filter("__r = 1").select(*df.columns)
    return single.unionByName(first)
