"""A hidden Markov language model, trained by Baum-Welch over all training documents and scored exactly.

Words are lower-cased (A-Z) and end in one end token for each document. The most frequent words (`own` of them) are
classes; every other word has the class of its last letters. Every counted training word has emissions of its own in
each state: within its class a state emits it by the word's add-one share there,
P_s(word) = P_s(class) (E_s(word) + 1) / (E_s(class) + words in class + 1), E_s being expected counts. A word that no
training document has gets E_s = 0. The sum over all words and one unknown word of each class is 1.

1. Words are counted in each partition, then summed by 64-bit hash. Words counted at least `t` times, at most FREQUENT
   of them, travel as a broadcast dictionary; all other words stay in the shared folder and are joined by hash to the
   rows that have them, so that what is gathered grows with the vocabulary.
2. Texts become sequences of word numbers once, staged beside their slim statistics; texts never move.
3. Baum-Welch steps fit starts, moves and class emissions. In these the words of a class are tied: their shares in it are
   the same in all states and cancel. Every sequence is cut into runs of RUN tokens, whose K x K transfer matrices chain
   to exact forward and backward messages at every cut, so that runs of all documents advance together in matrix
   operations whatever their lengths. Expected counts are summed in each partition, then in two shuffled steps. Steps end
   when one raises the mean log likelihood of a training token by less than TOLERANCE; no number of steps is set.
4. The last step is taken again with the words untied: every training word's expected counts by state are summed by hash, as whole
   numbers of 2 ** -32 so that their order doesn't matter.
5. The scaled forward recursion over transfer matrices of word emissions gives each text's exact likelihood.

The chain starts from the languages named in the table: state s first counts the words of the s-th most frequent one.

Defined cases: null text has only the end token; null doc_id is a training document; repeated rows are scored each;
with no training document every token has base share 1 and the states are alike; other columns are ignored.
"""

from __future__ import annotations

import gc
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, staged

K = 4
#: Nats a training token that a step must gain for another one to follow.
TOLERANCE = 1e-4
RUN = 64
FREQUENT = 1 << 18
OWN = 8_192
SHARED = 1_024
BLOCK = 1_024
CHUNK = 300_000
GROUP = 128
#: Pseudo-counts of a state's emissions, spread as the classes are in the corpus; and of its transitions, mostly to itself.
PRIOR, STAY, MOVE = 200.0, 50.0, 1.0
RESCALE = 16
UNIT = 2.0**32

LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"  # no word holds it
END_HASH = xxhash.xxh3_64_intdigest(END) - 2**63


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.translate(LOWERED).split() if text else ()), END]


def hashed(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def shared_class(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % SHARED


# -- counts -----------------------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a partition, given up whenever half a million words are held."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([hashed(w) for w in words], pa.int64()), pa.array([shared_class(w) for w in words], pa.int32()), pa.array(held.values(), pa.int64())], ["h", "b", "c"]
        )

    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            for x in batch.column(0).slice(at, GROUP).cast(pa.binary()).to_pylist():
                held.update(tokens(x))
            if len(held) > 500_000:
                yield out()
                held.clear()
    if held:
        yield out()


def count_words(training: DataFrame) -> DataFrame:
    """(h, b, c): each training token's hash, shared class and count."""
    ship(training.sparkSession)
    return training.select("text").mapInArrow(_count, "h long, b int, c long").groupBy("h", "b").agg(F.sum("c").alias("c"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least t for which at most `most` words are counted t times or more, from a histogram in steps of 2 ** (1 / 8)."""
    rows = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("e")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()
    total, t = 0, 2**62
    for r in sorted(rows, key=lambda r: -r.e):
        total += r.n
        if total > most:
            break
        t = r.low
    return t


class Lexicon(dict):
    """Local numbers of words, given when first asked for, and by them (number or -1, count or -1, hash, shared class). start() forgets all once `most` words are held."""

    def __init__(self, frequent: dict[int, tuple[int, int]], most: int = 300_000):
        self.frequent, self.most = frequent, most  # frequent: hash -> (count, number)
        self.fresh: list[int] = []
        self.held = np.empty((0, 4), dtype=np.int64)

    def __missing__(self, word: bytes) -> int:
        h = hashed(word)
        c, at = self.frequent.get(h, (-1, -1))
        self.fresh += (at, c, h, shared_class(word))
        self[word] = local = len(self)
        return local

    def start(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.held = self.held[:0]

    def about(self) -> np.ndarray:
        if self.fresh:
            self.held = np.concatenate([self.held, np.array(self.fresh, dtype=np.int64).reshape(-1, 4)])
            self.fresh = []
        return self.held


# -- the chain --------------------------------------------------------------------------------------------------------


class Chain:
    """start (K), move (K x K), emit (classes x K; the last row is padding, which changes nothing)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move = start, move
        self.emit = np.vstack([emit, np.ones((1, len(start)))])


def _runs(sequences: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded runs (RUN x S) and the number of runs of each sequence, whose runs stand together in order."""
    lengths = np.array([len(s) for s in sequences])
    many = -(-lengths // RUN)
    flat = np.full(int(many.sum()) * RUN, pad, dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(many)[:-1]]) * RUN
    for s, a in zip(sequences, at, strict=True):
        flat[a : a + len(s)] = s
    return np.ascontiguousarray(flat.reshape(-1, RUN).T), many


def _transfers(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled transfer matrices (S x K x K) of runs with emissions e (RUN x S x K), and the logs of their scales. A run's matrix starts with a move."""
    _, s, k = e.shape
    m = np.broadcast_to(np.eye(k), (s, k, k)).reshape(s * k, k).copy()
    logs = np.zeros(s)
    for t in range(len(e)):
        m = ((m @ move).reshape(s, k, k) * e[t][:, None, :]).reshape(s * k, k)
        if t % RESCALE == RESCALE - 1 or t == len(e) - 1:
            scale = np.maximum(m.reshape(s, k * k).sum(axis=1), 1e-300)
            m /= np.repeat(scale, k)[:, None]
            logs += np.log(scale)
    return m.reshape(s, k, k), logs


def _messages(chain: Chain, many: np.ndarray, m: np.ndarray, logs: np.ndarray, back: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward messages before each run, backward messages after it (both scaled), and each sequence's log likelihood. The chain's first state is drawn from start, which is a move from a state that no matrix knows, so that the message before the first run solves x @ move = start."""
    k = len(chain.start)
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    before, after = np.zeros((len(m), k)), np.ones((len(m), k))
    now = np.broadcast_to(np.linalg.solve(chain.move.T, chain.start), (len(many), k)).copy()
    total = np.zeros(len(many))
    for j in range(int(many.max(initial=0))):
        act = np.flatnonzero(many > j)
        at = first[act] + j
        before[at] = now[act]
        x = np.einsum("nk,nkl->nl", now[act], m[at])
        scale = np.maximum(x.sum(axis=1), 1e-300)
        total[act] += np.log(scale) + logs[at]
        now[act] = x / scale[:, None]
    now = np.ones((len(many), k))
    for j in range(int(many.max(initial=0)) - 1 if back else -1, -1, -1):
        act = np.flatnonzero(many > j)
        at = first[act] + j
        after[at] = now[act]
        x = np.einsum("nkl,nl->nk", m[at], now[act])
        now[act] = x / np.maximum(x.sum(axis=1), 1e-300)[:, None]
    return before, after, total


def log_likelihoods(chain: Chain, sequences: list[np.ndarray]) -> np.ndarray:
    runs, many = _runs(sequences, len(chain.emit) - 1)
    m, logs = _transfers(chain.emit[runs], chain.move)
    return _messages(chain, many, m, logs, back=False)[2]


def expectations(chain: Chain, sequences: list[np.ndarray], named: list[np.ndarray] | None = None, names: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected first states (K), moves (K x K) and emissions (classes x K), and the log likelihood. With named, sequences of numbers below `names` beside the classes, emissions are counted by these numbers."""
    k, pad = len(chain.start), len(chain.emit) - 1
    runs, many = _runs(sequences, pad)
    e = chain.emit[runs]
    m, logs = _transfers(e, chain.move)
    before, after, total = _messages(chain, many, m, logs)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = before
    for t in range(RUN):
        now = (now @ chain.move) * e[t]
        if t % RESCALE == RESCALE - 1:
            now = now / np.maximum(now.sum(axis=1), 1e-300)[:, None]
        alpha[t] = now
    now = after
    for t in range(RUN - 1, -1, -1):
        beta[t] = now
        now = (now * e[t]) @ chain.move.T
        if t % RESCALE == 0:
            now = now / np.maximum(now.sum(axis=1), 1e-300)[:, None]
    gamma = alpha * beta
    real = runs != pad
    gamma *= (real / np.maximum(gamma.sum(axis=2), 1e-300))[:, :, None]
    flat, rows = (runs.ravel(), pad) if named is None else (_runs(named, names)[0].ravel(), names)
    emit = np.stack([np.bincount(flat, weights=gamma[:, :, s].ravel(), minlength=rows + 1)[:rows] for s in range(k)], axis=1)
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    start = gamma[0, first].sum(axis=0)

    def moves(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.maximum(((x @ chain.move) * y).sum(axis=1), 1e-300)
        return chain.move * ((x / z[:, None]).T @ y)

    y = e * beta
    inside = real[1:].ravel()
    move = moves(alpha[:-1].reshape(-1, k)[inside], y[1:].reshape(-1, k)[inside])
    later = np.ones(len(before), dtype=bool)
    later[first] = False
    move += moves(before[later], y[0][later])
    return start, move, emit, float(total.sum())


def reestimated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, spread: np.ndarray) -> Chain:
    k = len(start)
    start = start + 1.0
    move = move + MOVE + STAY * np.eye(k)
    emit = emit + PRIOR * spread[:, None]
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and each list's length."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _chunks(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows that begin with (numbers, rare, times), about CHUNK tokens at a time: the rows, their sequences, the different hashes of rare words, which sequences number from `base`, these words' shared classes, the place of each word of `rare` among them, and their counts."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rare, many = _lists(rows.column(1))
        h, first, place = np.unique(rare, return_index=True, return_inverse=True)
        shared = _lists(rows.column(2))[0][first] & 65535
        at, starts = np.concatenate([np.arange(base), base + place]), np.cumsum(many) - many
        sequences = []
        for raw, o in zip(rows.column(0), starts, strict=True):
            s = np.frombuffer(raw.as_buffer(), dtype="<i4")
            sequences.append(at[np.where(s >= base, s + o, s)])
        return rows, sequences, h, shared, place, np.bincount(place, weights=_lists(rows.column(2))[0] >> 16, minlength=len(h))

    n = 0
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(0))) // 4
        at = 0
        for k, size in enumerate(sizes):
            n += int(size)
            if n >= CHUNK:
                held.append(batch.slice(at, k + 1 - at))
                yield out()
                held, n, at = [], 0, k + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield out()


SUMS = ["block", "part", "sums"]
SUMS_SCHEMA = "block int, part long, sums binary"
WORDS = ["h", "f", "c", *(f"e{s}" for s in range(K))]
WORDS_SCHEMA = "h long, f boolean, c long, " + ", ".join(f"e{s} long" for s in range(K))


def _packed(start: np.ndarray, move: np.ndarray, emit: np.ndarray, log: float) -> pa.RecordBatch:
    """A partition's sums as rows (block, part, sums): block -1 holds all but the emissions."""
    part = TaskContext.get().partitionId()
    rows = [(-1, np.concatenate([start, move.ravel(), [log]]))] + [(b, emit[a : a + BLOCK].ravel()) for b, a in enumerate(range(0, len(emit), BLOCK))]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([x.astype("<f8").tobytes() for _, x in rows], pa.binary())], SUMS)


def _words(h: np.ndarray, emit: np.ndarray, counts: np.ndarray, frequent: bool) -> pa.RecordBatch:
    """Words' counts and expected counts as rows (h, f, c, e0 ...)."""
    expected = (pa.array(np.rint(emit[:, s] * UNIT).astype(np.int64)) for s in range(K))
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(np.full(len(h), frequent)), pa.array(counts.astype(np.int64)), *expected], WORDS)


class Gathered:
    """Rare words' counts and expected counts by hash, given up whenever more than `most` are held."""

    def __init__(self, most: int = 400_000):
        self.most, self.n, self.held = most, 0, []

    def add(self, h: np.ndarray, emit: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((h, np.column_stack([emit, counts])))
        self.n += len(h)
        if self.n > self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            h, back = np.unique(np.concatenate([h for h, _ in self.held]), return_inverse=True)
            every = np.concatenate([x for _, x in self.held])
            sums = np.stack([np.bincount(back, weights=every[:, j], minlength=len(h)) for j in range(K + 1)], axis=1)
            yield _words(h, sums[:, :K], sums[:, K], False)
        self.n, self.held = 0, []


def _sum(pdf):
    import pandas as pd

    pdf = pdf.sort_values("part")
    total = np.frombuffer(pdf["sums"].iloc[0], dtype="<f8").copy()
    for x in pdf["sums"].iloc[1:]:
        total += np.frombuffer(x, dtype="<f8")
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0]], "sums": [total.tobytes()]})


def _summed(parts: DataFrame, n_parts: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    schema = "block int, part long, sums binary"
    some = max(1, int(n_parts**0.5))
    once = parts.groupBy("block", (F.col("part") % some).alias("shard")).applyInPandas(lambda pdf: _sum(pdf[["block", "part", "sums"]]), schema)
    rows = {r.block: np.frombuffer(r.sums, dtype="<f8") for r in once.groupBy("block").applyInPandas(_sum, schema).collect()}  # classes x states numbers
    if not rows:
        return np.zeros(K), np.zeros((K, K)), np.zeros((classes, K)), 0.0
    head = rows.pop(-1)
    emit = np.concatenate([rows[b].reshape(-1, K) for b in sorted(rows)])
    return head[:K], head[K : K + K * K].reshape(K, K), emit, float(head[-1])


def _forget_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffles of plans that nothing refers to any more: it does when the JVM collects them, and a driver with little garbage rarely does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Emissions:
    """Emissions of numbered words: own classes, then frequent words, whose shared classes are `shared`, then an unknown word of each shared class, which the others' follow from."""

    def __init__(self, own: int, shared: np.ndarray, words: np.ndarray):
        self.own, self.shared, self.words = own, shared, words  # words: different words in each shared class
        self.unknown = own + len(shared)
        self.size = self.unknown + SHARED
        #: the class of each number
        self.classes = np.concatenate([np.arange(own), own + shared, own + np.arange(SHARED)])

    def words_chain(self, chain: Chain, classes: np.ndarray, frequent: np.ndarray) -> Chain:
        """The chain over numbers, of the chain over classes and the expected counts of classes and of frequent words."""
        unknown = chain.emit[self.own : -1] / (classes[self.own :] + self.words[:, None] + 1)
        return Chain(chain.start, chain.move, np.vstack([chain.emit[: self.own], unknown[self.shared] * (frequent + 1), unknown]))


def with_rare(chain: Chain, unknown: int, shared: np.ndarray, fitted: np.ndarray) -> Chain:
    """The chain with rare words' emissions added."""
    return Chain(chain.start, chain.move, np.vstack([chain.emit[:-1], chain.emit[unknown + shared] * (fitted + 1)]))


def _ends(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())


def encoded(lex: Lexicon, texts: list[list[bytes]], size: int, whole: int) -> list[pa.Array]:
    """For each text: tokens, known tokens and base score of its frequent words; its sequence of numbers, where the k-th different rare word is size + k; and the rare words' hashes, and their times above the shared class's 16 bits."""
    lex.start()
    lengths = np.array([len(x) for x in texts])
    flat = np.fromiter(map(lex.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int64, count=int(lengths.sum()))
    about = lex.about()
    at, count = about[flat, 0], about[flat, 1]
    first = np.cumsum(lengths) - lengths
    base = np.where(count >= 0, np.log10((np.maximum(count, 0) + 1) / whole), 0.0)
    rare = np.flatnonzero(count < 0)
    text = np.repeat(np.arange(len(texts)), lengths)[rare]
    found, back, times = np.unique(text * len(about) + flat[rare], return_inverse=True, return_counts=True)
    local, of = found % len(about), found // len(about)
    many = np.bincount(of, minlength=len(texts))
    at[rare] = size + back - (np.cumsum(many) - many)[text]
    numbers = pa.Array.from_buffers(pa.binary(), len(texts), [None, _ends(lengths * 4).buffers()[1], pa.py_buffer(at.astype("<i4").tobytes())])
    lists = [pa.ListArray.from_arrays(_ends(many), pa.array(x, pa.int64())) for x in (about[local, 2], times << 16 | about[local, 3])]
    return [pa.array(lengths, pa.int64()), pa.array(np.add.reduceat(count > 0, first, dtype=np.int64)), pa.array(np.add.reduceat(base, first)), numbers, *lists]


def score(df: DataFrame, tolerance: float = TOLERANCE, own: int = OWN, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of df."""
    spark = df.sparkSession
    ship(spark)
    context = spark.sparkContext
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"), held_out(F.col("doc_id").cast("long")).alias("held_out"))

    words = staged(count_words(docs.filter(~F.col("held_out"))), "hmm-words")
    n_all, v_all = (words.agg(F.sum("c"), F.count("*")).first() or (0, 0))[:2]
    n_all = n_all or 0
    t, t_own = _least_count(words, frequent), _least_count(words, own - 1)
    top = words.filter(F.col("c") >= t).toArrow()  # at most `frequent` rows
    order = sorted(x for x in zip(*(top.column(c).to_pylist() for c in ("h", "c", "b")), strict=True) if x[0] != END_HASH)
    end = words.filter(F.col("h") == END_HASH).agg(F.sum("c")).first()[0] or 0
    numbers = {END_HASH: (end, 0)}  # the end token is class 0
    for at, (h, c, _) in enumerate((x for x in order if x[1] >= t_own), 1):
        numbers[h] = (c, at)
    others = [x for x in order if x[1] < t_own]
    for at, (h, c, _) in enumerate(others, own):
        numbers[h] = (c, at)
    # how many different words the shared classes hold
    owned = (F.col("h") == END_HASH) | (F.col("c") >= t_own)
    rest = {r.b: r.v for r in words.filter(~owned).groupBy("b").agg(F.count("*").alias("v")).collect()}
    table = Emissions(own, np.array([b for _, _, b in others], dtype=np.int64), np.array([rest.get(b, 0) for b in range(SHARED)], dtype=float))
    size, unknown, n_classes = table.size, table.unknown, own + SHARED
    other_hashes = np.array([h for h, _, _ in others], dtype=np.int64)
    langs = [r.lang for r in docs.filter(~F.col("held_out")).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(K).collect()]
    state = {lang: s for s, lang in enumerate(langs)}
    lexicon = context.broadcast(numbers)
    whole = n_all + 1 * (v_all + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(lexicon.value)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                made = encoded(lex, [tokens(x) for x in part.column(1).cast(pa.binary()).to_pylist()], size, whole)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *made], ["doc_id", "lang", "held_out", "n", "known", "base", "numbers", "rare", "times"])

    schema = "doc_id long, lang string, held_out boolean, n long, known long, base double, numbers binary, rare array<long>, times array<long>"
    coded = staged(docs.select("doc_id", "text", "lang", "held_out").mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id()), "hmm-numbers")
    training = coded.filter(~F.col("held_out"))
    n_parts = training.rdd.getNumPartitions()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = np.zeros((n_classes, K))
        for rows, sequences, _, shared, _, _ in _chunks(batches, size):
            of = np.concatenate([table.classes, own + shared])
            weights = np.array([np.arange(K) == state[x] if x in state else np.full(K, 1 / K) for x in rows.column(3).to_pylist()], dtype=float)
            flat, by = of[np.concatenate(sequences)], np.repeat(weights, [len(s) for s in sequences], axis=0)
            for s in range(K):
                emit[:, s] += np.bincount(flat, weights=by[:, s], minlength=n_classes)
        yield _packed(np.zeros(K), np.zeros((K, K)), emit, 0.0)

    _, _, classes, _ = _summed(training.select("numbers", "rare", "times", "lang").mapInArrow(first, SUMS_SCHEMA), n_parts, n_classes)
    spread = (classes.sum(axis=1) + 0.5) / (classes.sum() + 0.5 * len(classes))
    chain = reestimated(classes.sum(axis=0), np.eye(K) * classes.sum(axis=0)[:, None] * 0.05, classes, spread)
    before = -np.inf
    while True:
        told = context.broadcast(chain)

        def expect(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            total = None
            for _, sequences, _, shared, _, _ in _chunks(batches, size):
                of = np.concatenate([table.classes, own + shared])
                x = expectations(told.value, [of[s] for s in sequences])
                total = x if total is None else tuple(a + b for a, b in zip(total, x, strict=True))
            if total is not None:
                yield _packed(*total)

        start, move, classes, log = _summed(training.select("numbers", "rare", "times").mapInArrow(expect, SUMS_SCHEMA), n_parts, n_classes)
        _forget_shuffles(spark)
        if not n_all or log - before < tolerance * n_all:
            break
        told.unpersist()
        chain, before = reestimated(start, move, classes, spread), log

    def untie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_number, gathered = np.zeros((size, K)), Gathered()
        for _, sequences, h, shared, _, counts in _chunks(batches, size):
            of = np.concatenate([table.classes, own + shared])
            emit = expectations(told.value, [of[s] for s in sequences], sequences, size + len(h))[2]
            by_number += emit[:size]
            yield from gathered.add(h, emit[size:], counts)
        yield from gathered.out()
        some = own + np.flatnonzero(by_number[own:unknown].any(axis=1))
        yield _words(other_hashes[some - own], by_number[some], np.zeros(len(some)), True)

    # the step that ended the fit again, by words: its sums over classes are known already
    parts = training.select("numbers", "rare", "times").mapInArrow(untie, WORDS_SCHEMA)
    by_word = staged(parts.groupBy("h", "f").agg(F.sum("c").alias("c"), *(F.sum(f"e{s}").alias(f"e{s}") for s in range(K))), "hmm-fitted")
    del parts
    _forget_shuffles(spark)
    held = by_word.filter("f").toArrow()  # at most `frequent` rows
    by_hash = np.zeros((len(other_hashes), K))
    by_hash[np.searchsorted(other_hashes, held.column("h").to_numpy())] = np.stack([held.column(f"e{s}").to_numpy() / UNIT for s in range(K)], axis=1)
    last = context.broadcast(table.words_chain(reestimated(start, move, classes, spread), classes, by_hash))

    # counts of rare words, and their expected counts, come by a join on hashes
    about = by_word.filter("NOT f").select("h", "c", *((F.col(f"e{s}") / UNIT).cast("float").alias(f"e{s}") for s in range(K)))
    asked = coded.select("row", F.posexplode("rare").alias("i", "h"))
    found = asked.join(about, "h").groupBy("row").agg(F.collect_list(F.struct("i", "c", *(f"e{s}" for s in range(K)))).alias("told"))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sequences, h, shared, place, _ in _chunks(batches, size):
            told, many = rows.column(8), _lists(rows.column(1))[1]
            starts = np.cumsum(many) - many
            flat = told.flatten()
            of = np.repeat(starts, told.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + flat.field(0).to_numpy(zero_copy_only=False)
            counts, fitted = np.zeros(len(place), dtype=np.int64), np.zeros((len(h), K))
            counts[of] = flat.field(1).to_numpy(zero_copy_only=False)
            fitted[place[of]] = np.stack([flat.field(2 + s).to_numpy(zero_copy_only=False) for s in range(K)], axis=1)
            times = _lists(rows.column(2))[0] >> 16
            text = np.repeat(np.arange(len(many)), many)
            sums = lambda x, text=text, many=many: np.bincount(text, weights=x, minlength=len(many))
            known = sums(np.where(counts > 0, times, 0)).astype(np.int64) + rows.column(6).to_numpy(zero_copy_only=False)
            base = sums(times * np.log10((counts + 1) / whole)) + rows.column(7).to_numpy(zero_copy_only=False)
            chained = log_likelihoods(with_rare(last.value, unknown, shared, fitted), sequences) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [rows.column(3), rows.column(4), rows.column(5), pa.array(known), pa.array(np.full(len(many), n_all, dtype=np.int64)), pa.array(base), pa.array(chained)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    both = coded.join(found, "row", "left").select("numbers", "rare", "times", "doc_id", "held_out", "n", "known", "base", "told")
    return both.mapInArrow(forward, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
