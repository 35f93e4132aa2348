"""Incremental evaluation: results arrive in any order and more than once, and every step can be repeated.

Batches of a stream are written under their batch id, so a repeated batch replaces itself; readers take the newest row of
each key. Counts of attempts are stateful aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trivane.functions.states import long_if
from trivane.operators.windows import last_per_version


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def upsert(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch to target/batch=<id>; runs until the available input is done."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, keys: list[str], order: list) -> DataFrame:
    """The current row of each key over all batches; order gives the newest first, and later batches break ties."""
    return last_per_version(spark.read.parquet(target), keys, [*order, F.desc("batch")]).drop("batch")


def compact(spark: SparkSession, target: str, keys: list[str], order: list, out: str) -> None:
    """A copy of the current rows, as one batch of a new target."""
    latest(spark, target, keys, order).write.mode("errorifexists").parquet(f"{out}/batch=0")


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def attempts(events: DataFrame, keys: list[str], failed) -> DataFrame:
    """Failures and attempts by key; the same call counts a stream in update mode."""
    return events.groupBy(*keys).agg(long_if(failed).alias("failures"), F.count(F.lit(1)).alias("attempts"))


def retryable(work: DataFrame, ledger: DataFrame, keys: list[str], cap: int = 3) -> DataFrame:
    """Work that has failed fewer than cap times."""
    return work.join(ledger.where(F.col("failures") >= cap).select(*keys), keys, "left_anti")


def merged_summary(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows in their order, overridden by new ones of the same key; new keys follow."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*[c for c in both.columns if c != key])
    one = both.groupBy(key).agg(F.max_by(row, F.struct("_new", "pos")).alias("_r"), F.min(F.struct("_new", "pos")).alias("_first"))
    values = [F.col(f"_r.{c}").alias(c) for c in old.columns if c not in (key, "pos")]
    return one.select(key, *values, F.col("_first._new").cast("boolean").alias("added"), F.col("_first.pos").alias("pos"))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window of event time and kind; a stream drops what comes later than the watermark."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), kind, "n")
