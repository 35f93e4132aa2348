"""An audit of stored cases in runs that can be repeated: what holds is kept, the rest goes to quarantine with its reason.

A run looks only at tasks that no earlier run finished under the same schema version and source hash. It goes over their cases once
and writes them under its number, kept ones apart from quarantined ones, and then a row for each task, which says that the task is done. What is current of a task is what its latest finished run wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.operators.windows import first_qualifying
from trivane.session import stored

META = "task string, schema_version int, source_hash string, status string, kept long, quarantined long, states map<string,string>"


def category_state(count: Column, target: Column, strict: bool = False) -> Column:
    """State of a category by its target and what there is of it; the strict form knows no partial one."""
    return F.when(target == 0, "not_applicable").when(count >= target, "complete").otherwise("blocked" if strict else "partial")


def _tables(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")


def finished(spark: SparkSession, out: str) -> DataFrame:
    """The latest finished row of each task, with its run."""
    meta = _tables(spark, out, "meta")
    if meta is None:
        return spark.createDataFrame([], META + ", run int")
    return first_qualifying(meta, ["task"], [F.desc("run")], F.lit(True))


def current(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows of kept or quarantined cases that the latest finished run of their task wrote."""
    rows = _tables(spark, out, "cases").where(F.col("table") == name).drop("table")
    return rows.join(finished(spark, out).select("task", "run"), ["task", "run"], "left_semi")


def run(tasks: DataFrame, cases: DataFrame, out: str, number: int, version: int, target: int) -> DataFrame:
    """Audit the tasks that changed: (task, resumed) of all tasks.

    tasks: (task, source_hash, target: the function that counts, or null). cases: (task, kind, case_key, pos, valid, reason):
    whether the case holds when derived anew (null: not decided) and why not. Of equal keys the first by pos counts, the
    others are duplicates. A task without its function keeps nothing."""
    spark = tasks.sparkSession
    done = finished(spark, out).where(F.col("schema_version") == version).select("task", "source_hash", F.lit(True).alias("resumed"))
    # Written before the run counts as finished, as it reads what is finished; all that follows reads it.
    listed = stored(tasks.join(done, ["task", "source_hash"], "left").withColumn("resumed", F.coalesce("resumed", F.lit(False))), "audit")
    todo = listed.where("NOT resumed").select("task", "source_hash", "target")
    # The join has dealt the cases by task; a key's first is the one that a sorted stream of them meets first.
    stream = W.partitionBy("task", "kind", "case_key").orderBy(F.asc_nulls_last("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = cases.join(todo.select("task", "target"), "task").withColumn("_first", F.first("pos", ignorenulls=True).over(stream))
    reason = (
        F.when(F.col("target").isNull(), "target_not_found")
        .when(F.col("pos") > F.col("_first"), "duplicate_case")
        .when(F.col("valid"), None)
        .otherwise(F.coalesce("reason", F.lit("not_decided")))
    )
    own = own.select("task", "kind", "case_key", "pos", reason.alias("reason"))
    path, tables = f"{out}/cases/run={number}", ("kept", "quarantined")
    own.withColumn("table", F.when(F.col("reason").isNull(), tables[0]).otherwise(tables[1])).write.mode("overwrite").partitionBy("table").parquet(path)
    for t in tables:  # a table without rows has its columns all the same
        spark.createDataFrame([], own.schema).coalesce(1).write.mode("append").parquet(f"{path}/table={t}")
    each = spark.read.parquet(path).groupBy("task", "kind").agg(*[F.count_if(F.col("table") == t).alias(t) for t in tables])
    kinds = each.groupBy("task").agg(F.sum("kept").alias("kept"), F.sum("quarantined").alias("quarantined"), F.map_from_entries(F.collect_list(F.struct("kind", category_state(F.col("kept"), F.lit(target), strict=True)))).alias("states"))
    meta = todo.join(kinds, "task", "left").select(
        "task", F.lit(version).alias("schema_version"), "source_hash", F.when(F.col("target").isNull(), "no_function").otherwise("ok").alias("status"),
        F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"), "states",
    )
    meta.write.mode("overwrite").parquet(f"{out}/meta/run={number}")
    return listed.select("task", "resumed")
