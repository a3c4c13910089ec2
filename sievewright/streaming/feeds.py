"""Event feeds: the same plans for batches and, with a watermark, for streams; idempotent upserts for history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(df: DataFrame, late: str | None = None) -> DataFrame:
    """Events with a time zone aware timestamp, as watermarks need; late: how long to wait for stragglers in a stream."""
    made = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return made.withWatermark("ts", late) if late else made


def window_counts(df: DataFrame, size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows."""
    rows = df.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than `gap` between neighbours."""
    rows = df.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def last_n(df: DataFrame, n: int = 10) -> DataFrame:
    """Each user's last events, newest first. For batches."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return df.withColumn("place", rank).filter(F.col("place") <= n)


def timings(df: DataFrame, started: str = "agent_started", ended: tuple[str, ...] = ("agent_completed", "agent_failed")) -> DataFrame:
    """(user_id, event_id, event_type, elapsed): seconds from an agent's start to its completion or failure, the start being its last one before that. Other events don't take part. For batches."""
    rows = df.filter(F.col("event_type").isin(started, *ended))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("event_type") == started, F.col("ts")), ignorenulls=True).over(before)
    done = rows.withColumn("__s", start).filter(F.col("event_type").isin(*ended) & F.col("__s").isNotNull())
    return done.select("user_id", "event_id", "event_type", F.round(F.col("ts").cast("double") - F.col("__s").cast("double"), 3).alias("elapsed"))


def timed(df: DataFrame, timeout: float = 600.0, started: str = "agent_started", ended: tuple[str, ...] = ("agent_completed", "agent_failed")) -> DataFrame:
    """(user_id, event_id, outcome, elapsed): for each end of an agent whose last start is no more than `timeout` seconds before it the seconds between, under the end's type and id; for each start that is followed by no other start or end within the timeout the timeout, as 'timed_out' under the start's id. A repeated event counts once. For batches; timed_stream() gives the same rows."""
    rows = df.filter(F.col("event_type").isin(started, *ended)).dropDuplicates(["user_id", "event_id"]).withColumn("__t", F.unix_micros("ts"))
    w = Window.partitionBy("user_id").orderBy("__t", "event_id")
    begun = F.last(F.when(F.col("event_type") == started, F.col("__t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__s", begun).withColumn("__n", F.lead("__t").over(w))
    limit = int(timeout * 1_000_000)
    done = rows.filter(F.col("event_type").isin(*ended) & (F.col("__t") - F.col("__s") <= limit)).select("user_id", "event_id", F.col("event_type").alias("outcome"), F.round((F.col("__t") - F.col("__s")) / 1e6, 3).alias("elapsed"))
    lost = rows.filter((F.col("event_type") == started) & (F.col("__n").isNull() | (F.col("__n") - F.col("__t") > limit)))
    return done.unionByName(lost.select("user_id", "event_id", F.lit("timed_out").alias("outcome"), F.lit(float(timeout)).alias("elapsed")))


def timed_stream(df: DataFrame, timeout: float = 600.0, started: str = "agent_started", ended: tuple[str, ...] = ("agent_completed", "agent_failed")) -> DataFrame:
    """The streaming form of timed(), of events with a watermark. An event waits in state until the watermark has passed it, so that stragglers within the watermark's delay take their place and repeats fall together;
    a timer for each wakes it then, and another one each start when its time is over. State holds an agent's waiting events and its last start. Needs the RocksDB state store."""
    from .processors import AgentTimes

    rows = df.filter(F.col("event_type").isin(started, *ended)).select("user_id", "ts", "event_id", "event_type")
    made = AgentTimes(int(timeout * 1_000_000), started)
    return rows.groupBy("user_id").transformWithStateInPandas(made, "user_id long, event_id long, outcome string, elapsed double", "append", "eventTime")


def last_n_stream(df: DataFrame, n: int = 12) -> DataFrame:
    """The streaming form of last_n(): (user_id, place, event_id) whenever a user's last n events change, from state that holds n (ts, event_id) for each user."""

    def update(key, frames, state):
        import pandas as pd

        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in frames:
            held += list(zip(pdf["ts"].astype("int64").tolist(), pdf["event_id"].tolist(), strict=True))
        held = sorted(set(held), reverse=True)[:n]
        state.update(([t for t, _ in held], [e for _, e in held]))
        yield pd.DataFrame({"user_id": [key[0]] * len(held), "place": range(1, len(held) + 1), "event_id": [e for _, e in held]})

    rows = df.select("user_id", "ts", "event_id")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, place int, event_id long", "ts array<long>, ids array<long>", "update", "NoTimeout")


def read_json(spark: SparkSession, path: str, schema, late: str = "10 minutes") -> DataFrame:
    """A feed of JSON lines."""
    return events(spark.readStream.schema(schema).json(path), late)


def read(spark: SparkSession, path: str, schema, late: str = "10 minutes") -> DataFrame:
    return events(spark.readStream.schema(schema).parquet(path), late)


def newest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of each key's rows the one with the highest `order`."""
    columns = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*columns), F.col(order)).alias("__r")).select(*by, "__r.*")


def upsert(path: str, key: str, order: str, buckets: int = 16, combine: Callable[[DataFrame, list[str], str], DataFrame] = newest) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps one row for each key in a Parquet table of buckets by the key's hash, the newest, or what combine(rows, by, order) makes of a key's rows. A batch rewrites only the buckets that it touches, as new versions; batch b reads a bucket's newest version before b, so that a batch that runs again does no harm, and the versions before that one are deleted."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        rows = batch.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["__b"] for r in rows.select("__b").distinct().collect()]  # at most `buckets`
        held, old = versions(spark, path), []
        for b in touched:
            before = sorted(v for v in held.get(b, ()) if v < number)
            old += [f"{path}/b={b}/v={v}" for v in before[:-1]]
            if before:
                rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/b={b}/v={before[-1]}").withColumn("__b", F.lit(b)))
        made = combine(rows, [key, "__b"], order).select(*batch.columns, F.col("__b").alias("b"), F.lit(number).alias("v"))
        made.repartition("b").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b", "v").parquet(path)
        for x in old:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(x), True)

    return write


def history_of(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The state of history rows (key, content_hash, active, at): the newest says whether a source is active, a removed one keeps the last hash that it had, and one that returns is active again. Of equal times a row that is active counts."""
    last = F.struct(F.col(order), F.col("active").cast("int"))
    known = F.when(F.col("content_hash").isNotNull(), last)
    return rows.groupBy(*by).agg(F.max_by("content_hash", known).alias("content_hash"), F.max_by("active", last).alias("active"), F.max(order).alias(order))


def history_changes(diff: DataFrame, key: str = "url", at: str = "at") -> DataFrame:
    """History rows of a stream of changes (key, change, content_hash, at); sources that didn't change give none."""
    rows = diff.filter(F.col("change").isin("added", "changed", "removed"))
    return rows.select(key, F.when(F.col("change") != "removed", F.col("content_hash")).alias("content_hash"), (F.col("change") != "removed").alias("active"), at)


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket of an upsert() table."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for status in system.globStatus(hadoop.Path(f"{path}/b=*/v=*")) or ():
        at = status.getPath()
        found.setdefault(int(at.getParent().getName()[2:]), []).append(int(at.getName()[2:]))
    return found


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest rows of an upsert() table."""
    paths = [f"{path}/b={b}/v={max(v)}" for b, v in sorted(versions(spark, path).items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
