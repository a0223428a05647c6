"""Streams and resumable stages: new files numbered on behind what a scene has, samples with counters, stages that skip what
is there, and progress and cancelling of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_stream(spark: SparkSession, path: str, max_files: int = 1000, suffix: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of files as they arrive, at most max_files a step."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", f"*{suffix}") if suffix else reader).load(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "path") -> StreamingQuery:
    """Append a stream's rows to the table at target with `id`: numbers that go on behind the largest one there, in the order
    of key within a step. A step that is run again after a failure replaces its own rows, so none is numbered twice.

    A step's rows are numbered together: steps are bounded by the stream's settings. Rows of a key that the table has go.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates([key])
        last = 0
        if path_exists(spark, target):
            known = spark.read.parquet(target).where(F.col("step") != number)
            batch = batch.join(known.select(key), key, "left_anti")
            last = known.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1
        ids = F.row_number().over(W.orderBy(key)) - 1 + F.lit(last)
        out = batch.withColumn("id", ids.cast("long")).withColumn("step", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(target)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(df: DataFrame, name: str, reasons: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df without the rows of any reason, and an observation of how many rows each reason (the first that holds) took; it is
    known once an action has run. For a stream the counts are in its progress."""
    seen = Observation(name) if not df.isStreaming else None
    why = F.lit(None).cast("string")
    for k, c in reversed(reasons.items()):
        why = F.when(c, F.lit(k)).otherwise(why)
    told = df.withColumn("__why", why)
    counts = [F.count_if(F.coalesce(F.col("__why") == k, F.lit(False))).alias(k) for k in reasons] + [F.count(F.lit(1)).alias("rows")]
    told = told.observe(seen if seen is not None else name, *counts)
    return told.where("__why is null").drop("__why"), seen


def pending(work: DataFrame, done_path: str, keys: list[str], force: bool = False) -> DataFrame:
    """The rows of work whose keys the table at done_path has not; all of them with force or without such a table."""
    spark = work.sparkSession
    if force or not path_exists(spark, done_path):
        return work
    return work.join(spark.read.parquet(done_path).select(*keys).distinct(), keys, "left_anti")


def resume(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, made and written first if it is not there whole (or with force)."""
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def in_group(spark: SparkSession, group: str, run: Callable[[], object], text: str = "") -> object:
    """run() with its jobs in a group, so that another thread can follow or cancel them."""
    sc = spark.sparkContext
    sc.setJobGroup(group, text or group, interruptOnCancel=True)
    try:
        return run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def progress(spark: SparkSession, group: str) -> dict[str, int]:
    """Tasks of a group's jobs: all, active, completed and failed."""
    tracker = spark.sparkContext.statusTracker()
    out = {"tasks": 0, "active": 0, "completed": 0, "failed": 0}
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else []:
            s = tracker.getStageInfo(stage)
            if s:
                for k, v in (("tasks", s.numTasks), ("active", s.numActiveTasks), ("completed", s.numCompletedTasks), ("failed", s.numFailedTasks)):
                    out[k] += v
    return out


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows for each window (tumbling, or sliding by `slide`) and keys; rows later than `late` behind the newest are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))
