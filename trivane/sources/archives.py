"""Large files in parts: split with a manifest of sizes and hashes, verified part by part, and put together again.

Bytes are copied between streams of the file system, so a file need not fit in memory; hashes are computed in the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of the parts in a folder."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.part*").load(folder)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def split(spark: SparkSession, path: str, folder: str, part_bytes: int) -> DataFrame:
    """Write the parts of a file into a folder that must not exist, as <name>.part00000 and so on; returns their manifest."""
    fs, source = _fs(spark, path)
    out_fs, out = _fs(spark, folder)
    if out_fs.exists(out):
        raise ValueError(f"{folder} exists")
    left, k, copy = fs.getFileStatus(source).getLen(), 0, spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(source)
    while left > 0 or not k:
        n = min(left, part_bytes)
        part = out_fs.create(_fs(spark, f"{folder}/{source.getName()}.part{k:05d}")[1])
        copy.copyLarge(stream, part, 0, n)
        part.close()
        left, k = left - n, k + 1
    stream.close()
    return manifest(spark, folder)


def restore(spark: SparkSession, expected: DataFrame, folder: str, path: str) -> None:
    """Put the parts of a manifest together at a path that must not exist. A part that is missing, or whose size or hash is
    another one, is an error, and nothing is written."""
    found = manifest(spark, folder).select(F.col("name").alias("_n"), F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    ok = (F.col("size") == F.col("_s")) & (F.col("sha256") == F.col("_h"))
    checked = expected.join(found, F.col("name") == F.col("_n"), "left").select("name", F.coalesce(ok, F.lit(False)).alias("ok")).orderBy("name").collect()
    bad = [r["name"] for r in checked if not r["ok"]]
    fs, target = _fs(spark, path)
    if bad or not checked or fs.exists(target):
        raise ValueError(f"bad parts: {bad}" if bad else "no parts" if not checked else f"{path} exists")
    copy, out = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils, fs.create(target)
    for r in checked:
        part_fs, part = _fs(spark, f"{folder}/{r['name']}")
        stream = part_fs.open(part)
        copy.copyBytes(stream, out, 1 << 20, False)
        stream.close()
    out.close()
