"""Byte pair encoding and decoding through tables of distinct words.

A tokenizer that drops white space encodes the words of a text one by one. So texts are split into words, and each
distinct word is encoded once, wherever and however often it stands. Words come in two tables:

* Common words, at most MOST of them and each at most LONG bytes: those that stand LOCAL times or more in some task's
  texts, from the smallest power of two of occurrences that leaves no more than MOST. Their bound is proven, so they are
  encoded and broadcast, and texts are coded by their numbers, small ones for the commonest.
* All other words: a row for each word and chunk, about CHUNK bytes of text. The rows are dealt and sorted by word, each
  word is encoded as the rows stream by, and a join on the chunk puts the ids back at the word's positions.

Coded documents are a table bucketed by chunk, so that they stay where they are written while ids of the other words
come to them. A word that every document holds is a common one, or has one row for each chunk.

Decoding takes each id's piece from the tokenizer's table of pieces, at most a vocabulary's size and therefore
broadcast, and joins them in order. Tokenizers meant here have no decoder, for which the library puts one space between pieces.

Defined cases: null text counts as empty, which has no ids; a text of any length is one row of one chunk; repeated rows
give a row each; special tokens' strings inside texts become the special ids, as the library has it; other columns are
ignored; an empty table gives no rows. splits_words() refuses tokenizers whose ids may depend on neighbours of a word.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, ship, staged

#: Bytes of text in a chunk, at least one text.
CHUNK = 4 << 20
#: Common words: how many at most, how many bytes each, and how often in COUNTED bytes of a task's texts.
MOST, LONG, LOCAL, COUNTED = 1 << 20, 32, 3, 64 << 20
#: Other words whose ids are put together to one row for each chunk.
HELD = 200_000
_SPLIT = "chunk long, doc_id long, at binary, n int, word string"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def splits_words(tokenizer: str) -> bool:
    """Whether the tokenizer's ids of a text are those of its words, one after the other: it splits at white space and drops it, adds nothing before or after, and has no decoder, truncation or padding."""
    from tokenizers import Tokenizer

    made, parts = json.loads(tokenizer), ["a", "B.", "don't", "x9y", "é", "e\u0301", "--", "<|", "\u0301a", "日本", "a\u00a0b", "..."]
    t = Tokenizer.from_str(tokenizer)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    pairs = all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a in parts for b in parts for gap in (" ", "\n\t ", "\r\x0b\x0c"))
    return pairs and made.get("decoder") is None and made.get("truncation") is None and made.get("padding") is None


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of (id, text) with about CHUNK bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64)
    full = np.cumsum(sizes) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Ids and words of a chunk's documents."""
    held, size = [], 0

    def made() -> tuple[pa.Array, pa.ListArray]:
        table = pa.Table.from_batches(held)
        return table.column(0).combine_chunks(), pc.ascii_split_whitespace(pc.fill_null(table.column(1).combine_chunks(), ""))

    for batch in batches:
        for part in _parts(batch):
            n = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if held and size + n > CHUNK:
                yield made()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield made()


def _encoded(words: list[str], tokenizer) -> pa.ListArray:
    return pa.array([x.ids for x in tokenizer.encode_batch(words, add_special_tokens=False)], pa.list_(pa.int32()))


def _tokenizer(text: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_str(text)


def common_words(texts: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n): at most `most` words that stand often. texts: (id, text)."""

    def often(held: list[pa.Table]) -> pa.RecordBatch:
        n = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return n.filter(pc.greater_equal(n.column("n_sum"), LOCAL)).rename_columns(["word", "n"]).select(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, lists in _grouped(batches):
            found = pc.value_counts(lists.flatten())
            word = found.field(0)
            short = pc.less_equal(pc.binary_length(word), LONG)
            held.append(pa.table({"word": word.filter(short).cast(pa.string()), "n": found.field(1).filter(short)}))
            size += CHUNK
            if size >= COUNTED:
                yield from often(held).to_batches()
                held, size = [], 0
        if held:
            yield from often(held).to_batches()

    counted = staged(texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "bpe-counts")
    sizes = {r.power: r.words for r in counted.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words")).collect()}  # a row for each power of two
    least, total = 64, 0
    while least and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return counted.filter(F.floor(F.log2("n")) >= least)


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n, ids) of a table (word, n) of different words."""
    held = words.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _encoded(batch.column(0).to_pylist(), t)], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, ids array<int>")


def _bytes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as all their low bytes, then all their next ones and so on, which compresses well where most are small."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(held: bytes) -> np.ndarray:
    return np.frombuffer(held, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def split(texts: DataFrame, known) -> DataFrame:
    """Rows of two kinds: (chunk, doc_id, at), the numbers of a document's words, and (chunk, n, word), what a number beyond those of the common words stands for in a chunk. known: broadcast Arrow table of (word, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = known.value.column("word").combine_chunks()
        names = ["chunk", "doc_id", "at", "n", "word"]
        for ids, lists in _grouped(batches):
            chunk = uuid.uuid4().int >> 65
            coded = lists.flatten().dictionary_encode()
            number = np.array(pc.fill_null(pc.index_in(coded.dictionary, value_set=common), -1), dtype=np.int32)  # of each distinct word
            rare = np.flatnonzero(number < 0)
            number[rare] = len(common) + np.arange(len(rare), dtype=np.int32)
            offsets = np.asarray(lists.offsets)
            at, cuts = number[np.asarray(coded.indices)], (offsets - offsets[0]).tolist()
            for a in range(0, len(ids), 256):  # long rows in small batches
                part = pa.array([_bytes(at[x:y]) for x, y in zip(cuts[a : a + 256], cuts[a + 1 : a + 257], strict=False)], pa.binary())
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * k, pa.int64()), ids.slice(a, 256).cast(pa.int64()), part, pa.nulls(k, pa.int32()), pa.nulls(k, pa.string())], names)
            k = len(rare)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(number[rare]), coded.dictionary.take(pa.array(rare)).cast(pa.string())], names)

    return texts.mapInArrow(run, _SPLIT)


def other_ids(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(chunk, n, sizes, ids) of (chunk, n, word): rows of a word meet, it is encoded once for each batch that it reaches into, and words of a chunk share a row."""
    held = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def by_chunk(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        chunk, n, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
        lists = pa.concat_arrays([p[3] for p in parts])
        order = np.argsort(chunk, kind="stable")
        chunk, n, sizes, ids = chunk[order], n[order], sizes[order], lists.take(pa.array(order)).flatten()
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        rows = np.r_[first, len(chunk)]
        cuts = (rows, rows, np.r_[0, np.cumsum(sizes)][rows])
        cols = [pa.array([_bytes(x[a:b]) for a, b in zip(c[:-1], c[1:], strict=True)], pa.binary()) for x, c in zip((n, sizes, np.asarray(ids)), cuts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[first]), *cols], ["chunk", "n", "sizes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, parts, size = _tokenizer(held.value), [], 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            ids = _encoded(coded.dictionary.to_pylist(), t).take(coded.indices)
            parts.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(ids.value_lengths()), ids))
            size += batch.num_rows
            if size >= HELD:
                yield from by_chunk(parts)
                parts, size = [], 0
        if size:
            yield from by_chunk(parts)

    return rows.select("chunk", "n", "word").repartition("word").sortWithinPartitions("word").mapInArrow(run, "chunk long, n binary, sizes binary, ids binary")


def piece_table(tokenizer: str) -> pa.Array:
    """A tokenizer's pieces by id, special tokens included."""
    found = {i: p for p, i in _tokenizer(tokenizer).get_vocab(with_added_tokens=True).items()}
    return pa.array([found.get(i) for i in range(max(found, default=-1) + 1)], pa.string())


def _decoded(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Pieces of each list of ids, joined by a space; ids without a piece are left out, as by the library."""
    flat = ids.flatten()
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
    found = pieces.take(pc.if_else(inside, flat, None))
    offsets = np.asarray(ids.offsets) - ids.offsets[0].as_py()
    if found.null_count:
        some = np.asarray(found.is_valid())
        offsets, found = np.r_[0, np.cumsum(some)][offsets], found.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), " ")


def decode(df: DataFrame, tokenizer: str, key: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(key, decoded): the text of each list of ids, as the library's decode(ids, skip_special_tokens=False); null: empty."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(piece_table(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array(part.column(1).to_pylist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), _decoded(ids, held.value)], [key, "decoded"])

    return df.select(key, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("i")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, decoded string")


class Ids:
    """Ids of the common words and of a chunk's others, by their numbers."""

    def __init__(self, common: pa.Table, others: pa.Table | None):
        ids = common.column("ids").combine_chunks()
        self.values, self.sizes = np.asarray(ids.flatten(), dtype=np.int32), np.asarray(ids.value_lengths(), dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        if others is not None:
            n, sizes, values = (np.concatenate([_numbers(x) for x in others.column(c).to_pylist()]) for c in ("n", "sizes", "ids"))
            order = np.argsort(n, kind="stable")
            self.first = np.r_[self.first, (np.cumsum(sizes) - sizes + len(self.values))[order]]
            self.sizes, self.values = np.r_[self.sizes, sizes[order]], np.r_[self.values, values.astype(np.int32)]

    def of(self, at: pa.Array) -> pa.ListArray:
        """Ids of documents that are given by their words' numbers."""
        each = [_numbers(x) for x in at.to_pylist()]
        k = np.concatenate(each)
        sizes = self.sizes[k]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.first[k], sizes)
        offsets = np.r_[0, ends][np.cumsum([0, *map(len, each)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.values[place]))


def _restored(df: DataFrame, tokenizer: str, make, schema: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """make(document ids, lists of token ids) of all documents."""
    if not splits_words(tokenizer):
        raise ValueError("the tokenizer doesn't encode words one by one")
    spark = df.sparkSession
    ship(spark)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    listed = encode_words(common_words(texts, most), tokenizer).toArrow()  # at most `most` words of LONG bytes
    known = spark.sparkContext.broadcast(listed.sort_by([("n", "descending")]).select(["word", "ids"]).combine_chunks())
    cut = bucketed(split(texts, known), "chunk", "bpe-split")
    others = other_ids(cut.filter(F.col("word").isNotNull()), tokenizer)
    docs = cut.filter(F.col("word").isNull()).select(F.col("chunk").alias("chunk"), "doc_id", "at")

    def run(words: pa.Table, rows: pa.Table) -> pa.Table:
        ids = Ids(known.value, words if words.num_rows else None)
        return pa.concat_tables(make(*(part.column(part.schema.get_field_index(c)) if c == "doc_id" else ids.of(part.column(part.schema.get_field_index(c))) for c in ("doc_id", "at"))) for part in rows.to_batches(max_chunksize=256))

    return others.groupBy("chunk").cogroup(docs.groupBy("chunk")).applyInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""
    return _restored(df, tokenizer, lambda docs, ids: pa.table({"doc_id": docs, "ids": ids}), "doc_id long, ids array<int>", id_col, text_col, most)


def check_round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: digests of its ids, joined by a space, and of what they decode to."""
    held = df.sparkSession.sparkContext.broadcast(piece_table(tokenizer))

    def digests(x: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(b).hexdigest() for b in x.cast(pa.binary()).to_pylist()], pa.string())

    def make(docs: pa.Array, ids: pa.ListArray) -> pa.Table:
        listed = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
        return pa.table({"doc_id": docs, "n_tokens": ids.value_lengths().cast(pa.int64()), "ids_sha256": digests(listed), "decoded_sha256": digests(_decoded(ids, held.value))})

    return _restored(df, tokenizer, make, RESULT, id_col, text_col, most)
