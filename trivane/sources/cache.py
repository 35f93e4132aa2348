"""A store of results by key that stays where it is: bucketed and sorted by key, so that only requests move to meet it.

A result is stored under the key of its request (contracts.case_key of its canonical JSON) and is found by identity and key, so
that one of an older request counts as missing. The store is a table of the catalog, its files in a folder that executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def save(results: DataFrame, name: str, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Add results to the store, which is made when it isn't there; each bucket's files are sorted."""
    spark = results.sparkSession
    rows = results.repartition(buckets, key)
    if spark.catalog.tableExists(name):
        rows.write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    else:
        rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def lookup(requests: DataFrame, name: str, key: str, request: str, status: str = "status", absent: str = "not_attempted") -> DataFrame:
    """Requests with what is stored of them; absent where nothing is, or what is was asked under another request key.

    The join is on the bucketed key alone, which needs no exchange of the store; other requests' results are then dropped."""
    spark = requests.sparkSession
    store = spark.table(name)
    rest = [c for c in store.columns if c not in (key, request, status)]
    found = requests.join(store.withColumnRenamed(request, "_request"), key, "left")
    fits = F.col(request).eqNullSafe(F.col("_request")) & F.col("_request").isNotNull()
    return found.select(*requests.columns, F.when(fits, F.col(status)).otherwise(absent).alias(status), *[F.when(fits, F.col(c)).alias(c) for c in rest])


def misses(requests: DataFrame, name: str, key: str, request: str) -> DataFrame:
    """Requests that have to be made."""
    store = requests.sparkSession.table(name).select(F.col(key), F.col(request).alias("_request"))
    hit = requests.join(store, key).where(F.col(request) == F.col("_request")).select(key, request)
    return requests.join(hit, [key, request], "left_anti")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
