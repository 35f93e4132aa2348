"""Scans that keep what evidence needs: explicit schemas, checked keys and hashes, unreadable records that still count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_table(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Header CSV with a given schema; empty cells are null. Row order carries no meaning."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", multiLine=True, escape='"')


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_rows(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows; reading them fails if a key occurs twice. The check is a column of the plan, not a second job."""
    n = duplicate_keys(df, *keys).agg(F.count(F.lit(1)).alias("_dups"))
    checked = df.crossJoin(F.broadcast(n))  # one row
    first = F.when(F.col("_dups") == 0, F.col(keys[0])).otherwise(F.raise_error(F.lit("duplicate key")).cast(df.schema[keys[0]].dataType))
    return checked.withColumn(keys[0], first).drop("_dups")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """One record a file: path, name, raw, and record as a variant; null where the text is no JSON, and such rows stay."""
    t = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return t.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("value").alias("raw"), F.try_parse_json("value").alias("record"))


def hashed_json(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Records whose bytes have the SHA-256 that index (name, sha256) gives; another hash is an error when read."""
    b = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    x = b.join(index, "name").withColumn("digest", F.sha2("content", 256))
    text = F.when(F.col("digest") == F.col("sha256"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("hash mismatch: "), F.col("name"))))
    return x.select("name", "digest", F.parse_json(text).alias("record"))


def flagged_union(spark: SparkSession, paths: list[str], schema: StructType | str, folder: str) -> DataFrame:
    """CSV tables together; flag tells whether a row's file lies in a folder of that name."""
    df = spark.read.schema(schema).csv(paths, header=True, nullValue="")
    return df.withColumn("flag", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) == folder)


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path)


def source_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text; bytes that are no UTF-8 become replacement characters."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def manifest(df: DataFrame, catalog: DataFrame, key: str, **equal: str) -> DataFrame:
    """Manifest rows with the given field values and their catalog entry; a row without one is an error when read."""
    for k, v in equal.items():
        if v is not None:
            df = df.where(F.col(k) == v)
    x = df.join(catalog.withColumn("_known", F.lit(True)), key, "left")
    ok = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown "), F.col(key).cast("string"))).cast(df.schema[key].dataType))
    return x.withColumn(key, ok).drop("_known")


def split_sample_id(df: DataFrame, sample_id: str = "sample_id", sep: str = "|") -> DataFrame:
    """workflow, model, shot and task_id of a sample id; an id without four non-empty parts is an error."""
    parts = F.split(F.col(sample_id), "[" + sep + "]")
    good = (F.size(parts) == 4) & F.forall(parts, lambda x: x != "")
    safe = F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit("bad sample id: "), F.col(sample_id))).cast("array<string>"))
    return df.withColumns({n: safe[i] for i, n in enumerate(("workflow", "model", "shot", "task_id"))})


def paired_names(a: DataFrame, b: DataFrame, name: str, strict: bool) -> DataFrame:
    """Names on both sides. strict: a name on one side alone is an error when read; else it is left out."""
    x = a.select(name).distinct().withColumn("_a", F.lit(True)).join(b.select(name).distinct().withColumn("_b", F.lit(True)), name, "full_outer")
    both = F.col("_a") & F.col("_b")
    if strict:
        checked = F.when(both, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("unpaired: "), F.col(name).cast("string"))).cast(a.schema[name].dataType))
        return x.select(checked.alias(name))
    return x.where(both).select(name)


def unpaired_counts(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """One row: how many names only the left and only the right side has."""
    x = a.select(name).distinct().withColumn("_a", F.lit(1)).join(b.select(name).distinct().withColumn("_b", F.lit(1)), name, "full_outer")
    n = lambda c: F.count(F.when(c, F.lit(1)))
    return x.agg(n(F.col("_b").isNull()).alias("left_only"), n(F.col("_a").isNull()).alias("right_only"))


def catalog_lookup(df: DataFrame, catalog: DataFrame, keys: list[str], expected: str, actual: str) -> DataFrame:
    """Rows with their catalog entry by a composite key; incomplete entries don't count, and a stale hash is an error."""
    entries = catalog.dropna(subset=[*keys, expected])
    x = df.join(entries, keys)
    fresh = F.when(F.col(expected) == F.col(actual), F.col(actual)).otherwise(F.raise_error(F.lit("stale catalog hash")))
    return x.withColumn(actual, fresh)


def validated_cases(suites: DataFrame, current: DataFrame, schema_version: int = 3) -> DataFrame:
    """Cases of suites that still hold: of this schema version, complete, for the current source hash and target.

    suites: task_id, source_hash, target, schema_version, complete, cases (array of structs with status)."""
    ok = suites.where((F.col("schema_version") == schema_version) & F.col("complete"))
    live = ok.join(current.select("task_id", "source_hash", "target"), ["task_id", "source_hash", "target"], "left_semi")
    return live.select("task_id", F.posexplode("cases").alias("pos", "case")).where(F.col("case.status") == "validated")


def neighbour_violations(mapping: DataFrame, tasks: DataFrame, key: str = "task_id", neighbours: str = "neighbours", k: int = 5) -> DataFrame:
    """Rows of a neighbour mapping that break its rules, with the reason: k distinct known tasks other than the row's own,
    a row for every task and none for others."""
    n = F.col(neighbours)
    own = mapping.select(key, F.when((F.size(n) != k) | (F.size(F.array_distinct(n)) != k), "not k distinct").when(F.array_contains(n, F.col(key)), "own neighbour").alias("reason")).where("reason IS NOT NULL")
    each = mapping.select(key, F.explode(neighbours).alias("_n"))
    known = tasks.select(F.col(key).alias("_n")).distinct()
    unknown = each.join(known, "_n", "left_anti").select(key, F.lit("unknown neighbour").alias("reason"))
    missing = tasks.select(key).distinct().join(mapping, key, "left_anti").select(key, F.lit("no row").alias("reason"))
    extra = mapping.select(key).join(tasks, key, "left_anti").select(key, F.lit("unknown task").alias("reason"))
    return own.unionByName(unknown).unionByName(missing).unionByName(extra).distinct()


def regex_sums(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """For each pattern the sum of the numbers that its group 1 finds in a text; 0 for none and for a missing text."""
    add = lambda p: F.aggregate(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumns({k: add(p) for k, p in patterns.items()})


def ordered_factor(df: DataFrame, column: str, levels: list[tuple[str, str]]) -> DataFrame:
    """Labels for codes and their place in a fixed order: adds label and level."""
    dim = df.sparkSession.createDataFrame([(c, n, i) for i, (c, n) in enumerate(levels)], f"{column} string, label string, level int")
    return df.join(F.broadcast(dim), column, "left")


def suite_rollup(meta: DataFrame) -> DataFrame:
    """Counts by status over suites, missing counts as 0."""
    z = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return meta.groupBy("status").agg(F.count(F.lit(1)).alias("suites"), z("positive_count"), z("negative_count"), z("invalid_count"))


def variant_side(record: Column, metric: str, field: str, kind: str = "double") -> Column:
    """A field of a metric's generated side if there is such an object, else of the metric itself (P4).

    The choice is by the presence of the object, not of the field."""
    base = f"$.metrics.{metric}"
    there = F.try_variant_get(record, f"{base}.generated", "variant").isNotNull()
    return F.when(there, F.try_variant_get(record, f"{base}.generated.{field}", kind)).otherwise(F.try_variant_get(record, f"{base}.{field}", kind))
