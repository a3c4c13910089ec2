"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression class, for Java and for Python.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows in an Arrow batch.
ARROW_ROWS = 2_000

_shipped: set[str] = set()
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and a folder of our own where that is unset in local runs and tests; elsewhere that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sievewright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def partitioned(df: DataFrame, by: str, label: str) -> DataFrame:
    """staged() with a folder for each value of a whole-numbered column, so that a filter on it reads that folder alone."""
    return staged(df, label, by=by)


def staged(df: DataFrame, label: str, files: int | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again, which cuts its lineage with files that outlive an executor. files: for small tables, into how many files at most."""
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(spark)}/sievewright/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    for held in _scratch:
        held.append(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, label: str) -> DataFrame:
    """staged() as a table bucketed by a column, one bucket for each shuffle partition: groups and joins on it read their rows where they lie."""
    spark = df.sparkSession
    name, path = f"sievewright_{uuid.uuid4().hex}", f"{shared_dir(spark)}/sievewright/{label}-{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).option("compression", "zstd").saveAsTable(name)
    for held in _scratch:
        held.append(path)
    _forget_at_exit(spark, path)
    return spark.table(name)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then; the folder's owner cleans it
            _delete(spark, path)

    atexit.register(drop)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Yields a function that deletes what staged() has written inside the block; to be called once all results that read it are written themselves."""
    held: list[str] = []

    def drop() -> None:
        while held:
            _delete(spark, held.pop())

    _scratch.append(held)
    try:
        yield drop
    finally:
        _scratch.pop()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors once per application, so that Python workers can import them wherever they run. Whole texts travel in smaller Arrow batches than the default's 10,000 rows, which bounds what a worker and its JVM hold at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                at = os.path.join(folder, name)
                z.write(at, os.path.relpath(at, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="sievewright-code-"), "sievewright_code.zip")
    with open(path, "wb") as out:
        out.write(held.getvalue())
    spark.sparkContext.addPyFile(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, runs of characters other than SPACES; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors_of(lists: pa.Array, scaled: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a list array: which rows have it, and their scaled vectors. Vectors that are null, empty, or hold null or non-finite components, or such that aren't finite when scaled, are left out."""
    if pa.types.is_fixed_size_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan")))
    ends = np.cumsum(lengths)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        x = scaled(values[(ends[rows] - n)[:, None] + np.arange(n)])
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            yield rows[fine], x[fine]


class WordCache(dict):
    """Values of words, made by make() when first asked for. Two generations of at most `most` words bound its memory; words in use move to the young one."""

    def __init__(self, make: Callable[[str], object], most: int = 250_000):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> object:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


def chunks(rows: Iterable, size: int) -> Iterable[list]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
