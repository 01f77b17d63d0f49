"""File streams: new documents are keyed, deduplicated and upserted in micro-batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def stream_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(content, name, sha, mtime) of text files as they arrive; temporary files are ignored."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).schema("value string").load(path)
    rows = files.select(F.col("value").alias("content"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("mtime"))
    return rows.where(~F.col("name").rlike(r"(\.tmp|\.part|\.crdownload)$")).withColumn("sha", F.sha2("content", 256))


def dedup_stream(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """The first row of each key; a key that comes again within `delay` of event time is dropped, over restarts too.

    State holds the keys of the last `delay` before the watermark and no more. Rows without a time are dropped.
    """
    return stream.where(F.col(time).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str = "sha", time: str = "mtime", delay: str = "7 days") -> StreamingQuery:
    """Runs `transform` over rows whose key is new and appends them; all that waits is taken at once.

    Keys that come again within `delay` of event time are dropped by the stream's own state, so no earlier batch is read. A
    batch is written to its own folder, target/batch=N, so a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return dedup_stream(stream, key, time, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_events(stream: DataFrame, path: str = "path", time: str = "mtime") -> DataFrame:
    """(kind, name, at): what an arriving file is by its suffix and folder; others are left out."""
    low = F.lower(F.col(path))
    kind = F.when(low.endswith(".pdf") & low.contains("gaceta"), "gazette").when(low.endswith(".pdf"), "document").when(low.endswith(".md"), "text").when(low.endswith(".json"), "report")
    return stream.select(kind.alias("kind"), F.element_at(F.split(F.col(path), "/"), -1).alias("name"), F.col(time).alias("at")).where("kind IS NOT NULL")


def poll(spark: SparkSession, work: Callable[[SparkSession], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Writes what `work` finds at each tick, such as the next few incomplete rows after enrichment."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, _: write(work(batch.sparkSession))).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def once_a_date(spark: SparkSession, job: Callable[[], None], ledger: str, date: str) -> bool:
    """Runs the job unless the ledger folder holds its date, and notes the date after it; says whether it ran."""
    done = spark.read.schema("date string").option("recursiveFileLookup", "true").json(ledger).where(F.col("date") == date) if _there(spark, ledger) else None
    if done is not None and not done.isEmpty():
        return False
    job()
    spark.range(1).select(F.lit(date).alias("date")).write.mode("append").json(ledger)
    return True


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
    except AnalysisException:
        return False
    return True


def run_stages(first: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame], int]], folder: str) -> tuple[DataFrame, DataFrame]:
    """Runs (name, function, pct) stages one after the other; gives the last result and the progress rows.

    Each result is written to folder/NN_name and read as the next one's input. Progress has a row for each stage that
    began: (place, stage, status done or failed, pct, n_rows). Rows are counted by an observation within the writing job, so no
    table is read twice for it. A stage that fails ends the run: its row has no count and the pct of the stage before.
    """
    spark, rows, pct = first.sparkSession, [], 0
    for place, (name, work, after) in enumerate(stages):
        seen, path = Observation(), f"{folder}/{place:02d}_{name}"
        try:
            work(first).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        except PySparkException:
            rows.append((place, name, "failed", pct, None))
            break
        pct = after
        rows.append((place, name, "done", pct, seen.get["n"]))
        first = spark.read.parquet(path)
    return first, spark.createDataFrame(rows, "place int, stage string, status string, pct int, n_rows long")


class Progress(StreamingQueryListener):
    """The last progress events of all streams: (status, query, batch, rows)."""

    def __init__(self, most: int = 1000) -> None:
        self.events: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.events.append(("started", str(event.id), -1, 0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.events.append(("progress", str(event.progress.id), event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.events.append(("idle", str(event.id), -1, 0))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.events.append(("failed" if event.exception else "done", str(event.id), -1, 0))
