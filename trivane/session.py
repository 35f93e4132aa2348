"""Session helpers: the folder that executors share, and this package for their Python workers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session may go without, and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="trivane-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, by a zip file in the shared folder; once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/{root.name}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(raw.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(sc.applicationId)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dealt(df: DataFrame, *by: Column) -> DataFrame:
    """df in four parts for each core, for work that is dear for its bytes: neither the number of a table's files nor the size
    that Spark makes of a shuffle's parts then decides how many cores have some of it."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def gathered(df: DataFrame, parts: int, *keys: str | Column) -> DataFrame:
    """df in so many parts, rows of equal keys in one of them.

    They are dealt by a hash of the keys that no earlier step has dealt by: if one had dealt by the keys, Spark would leave
    this dealing out, and adaptive execution may then cut that step's parts, as nothing in the plan asks for them whole."""
    return df.repartition(parts, F.xxhash64(*keys))


def discard(*frames: DataFrame) -> None:
    """Delete tables written by stored() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
