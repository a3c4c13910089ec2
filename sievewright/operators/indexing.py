"""An incremental run of the index: one merge plan over the table of chunks and the table of parents.

A run reads the newest version of both tables before its own number and writes its own, so that a run which is started again
overwrites what it had begun and changes nothing else. Sources that a run doesn't see stay: another run may find other sources.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored

VERSION = 7
SOURCE = ["history_key", "url"]
CHUNKS = "id string, history_key string, url string, chunk_index int, chunk_count int, document string, content_hash string, metadata_schema_version int, change_status string, parent_id string"
PARENTS = "parent_id string, history_key string, url string, parent_index int, token_count int, content_hash string, content string"


class Run(NamedTuple):
    chunks: DataFrame
    parents: DataFrame
    summary: DataFrame


def plan(chunks: DataFrame, records: DataFrame, changes: DataFrame, first_run: bool = False, version: int = VERSION) -> DataFrame:
    """(history_key, url, content_hash, action, change_status, replaces, changed): what a run does with each record (history_key, url, content_hash). Contents take no part.

    A source is skipped if what is stored has its hash and the present schema, or if the run doesn't call it added or changed and what is stored is fresh and the same; else it is indexed, and
    what is stored of it goes. Everything is looked at anew in a first run and while the table of chunks is empty.
    """
    every = first_run or chunks.isEmpty()
    held = chunks.groupBy(*SOURCE).agg(F.min("content_hash").alias("held"), F.min("metadata_schema_version").alias("schema"))
    said = changes.filter(F.col("change").isin("added", "changed")).groupBy("url").agg(F.min("change").alias("said"))
    rows = records.select(*SOURCE, "content_hash").join(held, SOURCE, "left").join(said, "url", "left")
    stale = F.coalesce("schema", F.lit(0)) < version
    known = F.coalesce("held", F.lit("")) != ""
    same = F.coalesce("held", F.lit("")) == F.col("content_hash")
    untouched = F.lit(not every) & F.col("said").isNull() & ~stale & ~(known & ~same)
    status = F.lit("indexed") if every else F.coalesce("said", F.lit("unchanged"))
    rows = rows.withColumn("action", F.when(untouched | (same & ~stale), "skip").otherwise("index"))
    replaces = (F.col("action") == "index") & known & (~same | stale)
    return rows.select(*SOURCE, "content_hash", "action", status.alias("change_status"), replaces.alias("replaces"), (replaces & ~same).alias("changed"))


def run(chunks: DataFrame, parents: DataFrame, records: DataFrame, changes: DataFrame, split: Callable[[DataFrame], DataFrame], first_run: bool = False, version: int = VERSION) -> Run:
    """The tables after a run, and its summary as one row. split: records (history_key, url, content) to (history_key, url, chunk_index, document, parent_index, parent)."""
    steps = stored(plan(chunks, records, changes, first_run, version), "index-plan")
    open_ = steps.filter("action = 'index'")
    contents = records.join(open_.select(*SOURCE, "content_hash"), [*SOURCE, "content_hash"], "left_semi").select(*SOURCE, "content")
    made = stored(split(contents), "index-chunks")
    cut = made.groupBy(*SOURCE).agg(F.count("*").cast("int").alias("chunk_count"))
    done = open_.join(cut, SOURCE)  # a source without chunks counts as skipped, and what is stored of it stays
    key, url = F.col("history_key"), F.col("url")
    told = made.join(done, SOURCE).withColumn("parent_id", T.parent_id(key, url, F.col("parent_index"), F.col("parent")))
    new = told.select(T.chunk_id(key, url, F.col("chunk_index")).alias("id"), *SOURCE, F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_count", "document", "content_hash", F.lit(version).alias("metadata_schema_version"), "change_status", "parent_id")
    gone = done.filter("replaces").select(*SOURCE)
    # which rows go is settled by their ids, so that texts are moved once
    without = lambda held, more, key: held.join(held.select(key, *SOURCE).join(gone, SOURCE, "left_semi").select(key).unionByName(more.select(key)), key, "left_anti").select(*more.columns).unionByName(more)
    after = without(chunks, new, "id")
    # of the rows of one parent the last chunk's counts; a parent has one source, so its rows lie together already
    last = F.row_number().over(Window.partitionBy(*SOURCE, "parent_id").orderBy(F.desc("chunk_index")))
    text = T.clean(F.col("parent"))
    rows = told.filter(text != "").withColumn("r", last).filter("r = 1")
    own = rows.select("parent_id", *SOURCE, F.col("parent_index").cast("int").alias("parent_index"), T.token_count(F.col("parent")).cast("int").alias("token_count"), T.content_hash(text).alias("content_hash"), text.alias("content"))
    kept = without(parents, own, "parent_id")
    return Run(after, kept, _summary(steps, done, new, own, after, changes))


def _summary(steps: DataFrame, done: DataFrame, new: DataFrame, own: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """One row of counts, from single rows of counts."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(done, "indexed_sources"), count(new, "indexed_chunks"), count(after, "stored_chunks"), count(own, "indexed_parent_chunks"), done.agg(F.count_if("changed").alias("deleted_changed_sources")),
        changes.filter("change = 'removed'").agg(F.count_distinct("url").alias("preserved_removed_sources")), count(steps, "total_sources_seen"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of counts, one each
    return out.withColumn("skipped_sources", F.col("total_sources_seen") - F.col("indexed_sources")).withColumn("status", F.lit("success"))


def problems(status: Column, indexed_chunks: Column, stored_chunks: Column) -> Column:
    """What is wrong with a run's summary; an empty list if nothing is."""
    clean = T.clean(status)
    none = F.array().cast("array<string>")
    bad = F.array(F.concat(F.lit("rag_index status is "), F.when(clean == "", "missing").otherwise(clean)))
    zero = (F.coalesce(indexed_chunks, F.lit(0)) <= 0) & (F.coalesce(stored_chunks, F.lit(0)) <= 0)
    return F.when(clean != "success", bad).when(zero, F.array(F.lit("rag_index indexed zero chunks"))).otherwise(none)


def versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop.Path(f"{path}/chunks/v=*/_SUCCESS")) or ()
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)


def read(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The newest tables, or the newest before a run's number."""
    held = [v for v in versions(spark, path) if before is None or v < before]
    tables = [(kind, schema, f"{path}/{kind}/v={held[-1]}" if held else "") for kind, schema in (("chunks", CHUNKS), ("parents", PARENTS))]
    return tuple(spark.read.schema(schema).parquet(at) if at else spark.createDataFrame([], schema) for _, schema, at in tables)


def write(path: str, number: int, records: DataFrame, changes: DataFrame, split: Callable[[DataFrame], DataFrame], first_run: bool = False, version: int = VERSION) -> DataFrame:
    """Run `number` on stored tables; gives its summary. Parents are written first, so that a version of chunks always has its parents."""
    spark = records.sparkSession
    made = run(*read(spark, path, number), records, changes, split, first_run, version)
    stored(made.parents, "parents", f"{path}/parents/v={number}")
    stored(made.chunks, "chunks", f"{path}/chunks/v={number}")
    return made.summary
