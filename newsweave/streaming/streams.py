"""Streaming forms of the polled jobs, with Structured Streaming.

Sinks are tables whose partitions are micro-batches: a replayed batch overwrites its own
partition, so results are exactly-once although ``foreachBatch`` is at-least-once. Reading
views fold the partitions. Every stream ends by itself (``availableNow``) unless given
another trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.operators.interactions import LOG, fold_interactions
from newsweave.operators.ranking import first_per_group
from newsweave.session import scratch_path

LATE = "run string, batch long, rows long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state on executor disks with checkpoints in the shared folder, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def read_files(spark: SparkSession, folder: str, schema, name: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of ``folder`` as a stream; ``name`` is a glob on file names."""
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, out: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None,
                 trigger: dict | None = None) -> str:
    """Run ``stream`` into ``out``, one ``batch=<id>`` partition per micro-batch; ``each`` may turn a
    batch into what is stored. Returns the table folder. How many rows came behind the watermark is kept beside it (``late_rows``)."""
    use_disk_state(stream.sparkSession)
    table = f"{out}/table"

    seen: dict[int, int] = {}
    running: list = []

    def note() -> None:
        """Keep what the query reports of its batches. It forgets old ones, so this runs with every batch."""
        for p in running[0].recentProgress if running else []:
            seen[p["batchId"]] = max(seen.get(p["batchId"], 0), sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]))

    def write(batch: DataFrame, batch_id: int) -> None:
        note()
        rows = each(batch, batch_id) if each else batch
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
             .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start())
    running.append(query)
    try:
        query.awaitTermination()
    finally:
        note()
        counted = [(str(query.runId), n, late) for n, late in sorted(seen.items())]
        stream.sparkSession.createDataFrame(counted, LATE).coalesce(1).write.mode("append").parquet(f"{out}/late")
    return table


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """(run, batch, rows): rows that each batch of each run into ``out`` left out because they came behind the watermark. Rows of a window
    are counted after each task has added up its own, so one may stand for several arrivals; those of a dedup are single arrivals."""
    return spark.read.schema(LATE).parquet(f"{out}/late")


def latest(table: DataFrame, key: list[str]) -> DataFrame:
    """Last update of every key of a table written in update mode."""
    return first_per_group(table, key, [F.col("batch").desc()]).drop("batch")


# -- articles --------------------------------------------------------------------------

def dedup_articles(stream: DataFrame, time: str, keep: str = "40 days", key: str = "article_url") -> DataFrame:
    """First arrival per URL; a URL is remembered for ``keep`` of event time, which bounds the state."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


# -- reader state ----------------------------------------------------------------------

def last_commands(log: DataFrame) -> DataFrame:
    """A log cut to the commands that still matter: per (user, article) the last one that sets the read
    flag and the last one that sets the like flag. Folding it gives the same state."""
    turn = F.struct("interaction_at", "event_id")
    read = F.max_by("is_read", F.when(F.col("is_read").isNotNull(), turn))
    like = F.max_by("is_liked", F.when(F.col("is_liked").isNotNull(), turn))
    last = lambda flag: F.max(F.when(F.col(flag).isNotNull(), turn))
    none = F.lit(None).cast("boolean")
    both = log.groupBy("user_id", "content_id").agg(read.alias("r"), last("is_read").alias("rt"), like.alias("l"), last("is_liked").alias("lt"))
    row = lambda r, l, t: F.struct(r.alias("is_read"), l.alias("is_liked"), t["interaction_at"].alias("interaction_at"), t["event_id"].alias("event_id"))
    rows = F.filter(F.array(row(F.col("r"), none, F.col("rt")), row(none, F.col("l"), F.col("lt"))), lambda x: x["event_id"].isNotNull())
    return both.select("user_id", "content_id", F.explode(rows).alias("x")).select("user_id", "content_id", "x.*").select(*LOG)


def fold_stream(log: DataFrame, out: str) -> DataFrame:
    """Reader state from a stream of commands. Each batch appends its own reduced commands; the state is
    the fold over them, so no batch rewrites the state table and late commands fall into place."""
    table = run_to_table(log.select(*LOG), out, each=lambda batch, _: last_commands(batch))
    return fold_interactions(None, log.sparkSession.read.parquet(table))


def compact_commands(spark: SparkSession, table: str, out: str) -> None:
    """Write the reduced commands of all batches of ``table`` to the new table ``out``: at most two rows
    per (user, article), so the state view stays as large as the state."""
    last_commands(spark.read.parquet(table)).write.mode("errorifexists").parquet(out)


# -- windows ---------------------------------------------------------------------------

def daily_topic_counts(stream: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Interactions and reads per (day, topic) in tumbling windows."""
    return (stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), "topic")
            .agg(F.count("*").alias("interaction_count"), F.count_if("is_read").alias("view_count"))
            .select(F.to_date("w.start").alias("date"), "topic", "interaction_count", "view_count"))


def sliding_topic_counts(stream: DataFrame, time: str, span: str = "24 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Interactions per topic over the last ``span``, moved by ``step``."""
    return (stream.withWatermark(time, late).groupBy(F.window(time, span, step).alias("w"), "topic")
            .agg(F.count("*").alias("interaction_count"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "topic", "interaction_count"))


def reader_sessions(stream: DataFrame, time: str, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user that end after ``idle`` without an event; a session is given out once closed."""
    return (stream.withWatermark(time, late).groupBy("user_id", F.session_window(time, idle).alias("s"))
            .agg(F.count("*").alias("events"))
            .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events"))


def open_sessions(spark: SparkSession, out: str) -> DataFrame:
    """Sessions not yet closed, as the state of the stream into ``out`` holds them; no event is read again."""
    held = spark.read.format("statestore").load(f"{out}/checkpoint")
    return held.select("value.user_id", F.col("value.session_window.start").alias("session_start"), F.col("value.session_window.end").alias("session_end"),
                       F.col("value.count").alias("events"))


def new_output(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)
