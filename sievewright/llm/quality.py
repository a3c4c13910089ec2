"""Quality rules: base rules on word statistics, then a robust multivariate outlier test per language and source.

The robust location and scatter of each (lang, source) group are minimum-covariance-determinant estimates. Two
deterministic starts (medians with quartile scales; mean and covariance of the group) are refined by concentration
steps: keep the share SUPPORT of the group's rows that lies closest, estimate again. The start with the smaller
determinant wins. A document goes if its squared Mahalanobis distance exceeds the
chi-square quantile at 1 - TAIL. The scatter of this distance is the group's and, added to it, the sampling error of the
document's own statistics: a short text's shares move by chance alone.

Everything is a DataFrame plan. Vectors are rounded to 1/GRID, equal vectors of a group are counted before anything
else, all sums are exact integers, and the cut of a concentration step comes from a histogram of distances, so that
no group's rows ever meet in one task and a rerun gives the same estimates. Only tables with a row for each group
travel, and these are broadcast only if they have at most BROADCAST_GROUPS rows.

Defined cases: null text has no words and fails the base rules; null lang or source counts as ''; a group with fewer
than MIN_GROUP rows that pass the base rules uses the estimate of its language, and that of all rows if the language
has too few as well, and no row is rejected if even all rows are too few; repeated rows are judged alike; columns of
the input that share a name with an output are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, staged, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Dimensions of the statistic vector.
P = 4
GRID = 256
SUPPORT = 0.75
STEPS = 5
MIN_GROUP = 40
TAIL = 1e-4
#: Least standard deviation of the four statistics, the unit they are rounded to: no scatter is singular.
FLOOR = 1 / GRID
#: Sampling variance of the four statistics of one word, character, line and word: (cv of word lengths) ** 2; 1 / 4 for an angular share, times the WINDOW words that repeat together.
SAMPLING = (0.25, 0.25, 0.25, 0.25 * WINDOW)
BROADCAST_GROUPS = 20_000
#: Files of a staged table: FEW, and one more for each ROWS_A_FILE rows.
FEW, ROWS_A_FILE = 8, 250_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice."""

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(
            order,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))),
                    lambda e: e["i"],
                )
            ),
        )
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
            ),
        )

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def statistics(text: Column) -> Column:
    """A struct with the base statistics of a text, and its lines that have a word."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(full, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def describe(df: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One slim row for each row of df: carry, its group, the base statistics and the base verdict."""
    s = F.col("__s")
    return (
        df.select(*(F.col(c) for c in carry), F.coalesce(F.col("lang"), F.lit("")).alias("__lang"), F.coalesce(F.col("source"), F.lit("")).alias("__source"), statistics(F.col("text")).alias("__s"))
        .select(
            *carry, "__lang", "__source", s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
            s["lines"]["dup"].alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"), s["lines"]["n"].alias("__n_lines"),
            base_failed(s["n_words"], s["n_repeat_words"]).alias("base_failed"),
        )
    )


def _vector() -> list[Column]:
    """The transformed statistics as integers in units of 1 / GRID: log mean word length, and angular transforms of the shares of symbols, of repeated lines and of repeated words."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("__n_lines")
    angle = lambda x, of: F.asin(F.sqrt(F.least(F.lit(1.0), x / F.greatest(of, F.lit(1)))))
    parts = [F.ln(F.greatest(chars, F.lit(1)) / F.greatest(n, F.lit(1)) / 5.0), angle(F.col("n_symbols"), chars), angle(F.col("n_dup_lines"), lines), angle(F.col("n_repeat_words"), n)]
    return [F.round(x * GRID).cast("long").alias(f"x{i}") for i, x in enumerate(parts)]


def _sampling() -> list[Column]:
    """The variances that chance gives a text's own statistics."""
    of = (F.col("n_words"), F.col("word_chars"), F.col("__n_lines"), F.col("n_words"))
    return [F.lit(v) / F.greatest(n, F.lit(1)) for v, n in zip(SAMPLING, of, strict=True)]


X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _moments(weight: Column) -> list[Column]:
    exact = lambda c: F.sum((c * weight).cast("decimal(38,0)"))
    return [F.sum(weight).alias("n"), *(exact(F.col(x)).alias(f"s{x}") for x in X), *(exact(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS)]


def _inverted(cov: Column) -> Column:
    """Gauss-Jordan sweeps of a positive definite P x P matrix, held by rows: its inverse a and the log ld of its determinant."""
    first = F.struct(cov.alias("a"), F.lit(0.0).alias("ld"))

    def sweep(s: Column, k: Column) -> Column:
        def cell(v: Column, t: Column, a: Column, d: Column) -> Column:
            i, j = F.floor(t / P).cast("int"), t % P
            row, col = F.get(a, k * P + j), F.get(a, i * P + k)
            return F.when((i == k) & (j == k), 1.0 / d).when(i == k, v / d).when(j == k, -v / d).otherwise(v - col * row / d)

        d = F.get(s["a"], k * P + k)
        return F.struct(F.transform(s["a"], lambda v, t: cell(v, t, s["a"], d)).alias("a"), (s["ld"] + F.ln(d)).alias("ld"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), first, sweep)


def _model(m: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Location, inverse scatter and log determinant from the moments of the support."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{x}").cast("double") / n / GRID for x in X]
    cell = {(i, j): F.col(f"s{i}{j}").cast("double") / n / GRID**2 - mean[i] * mean[j] for i, j in PAIRS}
    cov = F.array(*(cell[min(i, j), max(i, j)] * factor + (FLOOR**2 if i == j else 0.0) for i in range(P) for j in range(P)))
    return m.select(*keys, F.array(*mean).alias("at"), _inverted(cov).alias("inv"), cov.alias("cov"))


def _distance() -> Column:
    d = [F.col(X[i]) / float(GRID) - F.get(F.col("at"), F.lit(i)) for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(P):
            total = total + d[i] * d[j] * F.get(F.col("inv")["a"], F.lit(i * P + j))
    return F.greatest(total, F.lit(0.0))


def _bounded(params: DataFrame) -> DataFrame:
    """params for a join: broadcast if it is small, else left to a shuffled join."""
    return F.broadcast(params) if len(params.limit(BROADCAST_GROUPS + 1).select("g").collect()) <= BROADCAST_GROUPS else params


def chi_square_cdf(x: float, p: int) -> float:
    """For even p."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, p) < q else (low, mid)
    return high


def consistency() -> float:
    """What makes the scatter of the central SUPPORT of a normal group an estimate of the whole group's."""
    return SUPPORT / chi_square_cdf(chi_square_quantile(SUPPORT, P), P + 2)


def fit(stats: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates: a row (lang, source, at, cov) for each group of describe()'s rows."""
    ok = stats.filter(~F.col("base_failed")).select("__lang", "__source", *_vector())
    sizes = ok.groupBy("__lang", "__source").agg(F.count("*").alias("n")).select(F.col("__lang"), F.col("__source"), "n")
    sizes = staged(sizes, "quality-groups", FEW)
    all_rows = sizes.agg(F.sum("n")).first()[0] or 0
    files = FEW + all_rows // ROWS_A_FILE
    langs = sizes.groupBy("__lang").agg(F.sum("n").alias("n_lang"))
    chosen = sizes.join(langs, "__lang").select(
        "__lang", "__source",
        F.when(F.col("n") >= MIN_GROUP, F.concat(F.lit("s\0"), "__lang", F.lit("\0"), "__source")).when(F.col("n_lang") >= MIN_GROUP, F.concat(F.lit("l\0"), "__lang")).otherwise(F.lit("a")).alias("g"),
    )
    counted = staged(ok.groupBy("__lang", "__source", *X).agg(F.count("*").alias("c")), "quality-vectors", files)
    # a row counts towards its own group, its language and all rows; groups that nobody uses are dropped
    wide = counted.select(
        F.explode(F.array(F.concat(F.lit("s\0"), "__lang", F.lit("\0"), "__source"), F.concat(F.lit("l\0"), "__lang"), F.lit("a"))).alias("g"), *X, "c"
    ).groupBy("g", *X).agg(F.sum("c").alias("c"))
    used = chosen.select("g").distinct()
    vectors = staged(wide.join(_bounded(used), "g", "left_semi"), "quality-used", files)
    model = None
    for step in range(STEPS + 1):
        if model is None:
            quart = lambda x: F.expr(f"percentile({x}, array(0.25D, 0.5D, 0.75D), c)")
            first = vectors.groupBy("g").agg(*_moments(F.col("c")), *(quart(x).alias(f"q{x}") for x in X))
            whole = _model(first, ["g"], 1.0).withColumn("start", F.lit(1))
            spread = [F.pow((F.get(F.col(f"q{x}"), F.lit(2)) - F.get(F.col(f"q{x}"), F.lit(0))) / (1.349 * GRID), 2) for x in X]
            diagonal = F.array(*(spread[i] + FLOOR**2 if i == j else F.lit(0.0) for i in range(P) for j in range(P)))
            median = first.select("g", F.array(*(F.get(F.col(f"q{x}"), F.lit(1)) / float(GRID) for x in X)).alias("at"), _inverted(diagonal).alias("inv"), diagonal.alias("cov"), F.lit(0).alias("start"))
            model = staged(whole.unionByName(median), "quality-start", FEW)
            continue
        far = vectors.join(_bounded(model), "g").select("g", "start", *X, "c", _distance().alias("d"))
        far = far.withColumn("bin", F.floor(F.log2(F.col("d") + 1 / 1024) * 16).cast("int"))
        # moments by group, start and bin of distance; the cut is the first bin at which the support is full
        binned = far.groupBy("g", "start", "bin").agg(*_moments(F.col("c")))
        binned = staged(binned, "quality-bins", FEW)
        by = "PARTITION BY g, start"
        held = binned.withColumn("upto", F.expr(f"sum(n) OVER ({by} ORDER BY bin)")).withColumn("whole", F.expr(f"sum(n) OVER ({by})"))
        held = held.filter(F.col("upto") - F.col("n") < F.ceil(F.col("whole") * SUPPORT))
        total = held.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{x}" for x in X), *(f"s{i}{j}" for i, j in PAIRS)]))
        model = staged(_model(total, ["g", "start"], consistency()), "quality-step", FEW)
    best = model.groupBy("g").agg(F.min_by(F.struct("at", "cov"), F.struct(F.col("inv")["ld"], F.col("start"))).alias("m"))
    out = chosen.join(best, "g").select(F.col("__lang"), F.col("__source"), F.col("g"), F.col("m")["at"].alias("at"), F.col("m")["cov"].alias("cov"))
    return staged(out.filter(F.lit(all_rows >= MIN_GROUP)), "quality-model", FEW)


def verdicts(stats: DataFrame, model: DataFrame) -> DataFrame:
    """stats with distance (squared; null where no estimate is made) and kept."""
    names = stats.columns
    limit = chi_square_quantile(1 - TAIL, P)
    joined = stats.select("*", *_vector()).join(_bounded(model), ["__lang", "__source"], "left")
    own = _sampling()
    cells = F.array(*(F.get(F.col("cov"), F.lit(i * P + j)) + (own[i] if i == j else F.lit(0.0)) for i in range(P) for j in range(P)))
    judged = ~F.col("base_failed") & F.col("cov").isNotNull()
    joined = joined.withColumn("inv", F.when(judged, _inverted(cells)))
    far = joined.select(*names, F.when(judged, _distance()).alias("distance"))
    return far.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > limit, F.lit(False)))


def judge(df: DataFrame) -> DataFrame:
    """A row for each row of df: doc_id, the base statistics, base_failed, distance and kept."""
    stats = staged(describe(df), "quality-stats")
    return verdicts(stats, fit(stats)).select("doc_id", *BASE, "base_failed", "distance", "kept")


def filter_documents(df: DataFrame) -> DataFrame:
    """The rows of df that the rules keep, with df's columns. Rows are staged beside their statistics, so that these are computed once; the fit reads the statistics alone, and texts never move."""
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), "lang", "source", "text")
    held = staged(describe(whole, ("__row",)), "quality-rows")
    kept = verdicts(held, fit(held.drop("__row"))).filter("kept")
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in df.columns))
