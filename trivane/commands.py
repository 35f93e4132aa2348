"""What the command line does beyond single queries: check files against a manifest, reproduce results, evaluate a data set."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.functions import registry
from trivane.functions.metrics import EVIDENCE
from trivane.sources import scans
from trivane.streaming import incremental

IDENTITY = ("workflow", "model", "shot", "task_id")
OUTCOMES = "name string, side string, " + ", ".join(f"{k} {t}" for k, t in EVIDENCE.items() if k != "text")


def file_differences(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """(path, problem) of files that aren't what a manifest says: missing, changed or unlisted. The manifest is a CSV file of
    path (below the folder) and sha256; files are hashed where they are read."""
    listed = scans.unique_rows(scans.csv_table(spark, manifest, "path string, sha256 string"), "path")
    root = folder.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = F.substring_index(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), root, -1)
    found = found.select(at.alias("path"), F.sha2("content", 256).alias("digest"))
    both = listed.join(found, "path", "full_outer")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("digest") != F.lower("sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def row_differences(a: DataFrame, b: DataFrame) -> int:
    """How many rows, counted with their repetitions, only one of two tables of the same columns has."""
    b = b.select(*a.columns)
    return a.exceptAll(b).count() + b.exceptAll(a).count()


def reproduce(spark: SparkSession, tables: str, out: str, names: Iterable[str], against: str | None = None) -> dict:
    """Run queries over tables, write each result below out, and compare it with that of an earlier run.

    The report, written after every stage to out/report.json, has the seconds, rows and differing rows of each. A query that
    fails or differs makes the whole run fail, after the others have been run."""
    from trivane import catalog

    folder = Path(out)
    if folder.exists() and any(folder.iterdir()):
        raise SystemExit("the output folder must be empty")
    unknown = sorted(set(names) - set(catalog.QUERIES))
    if unknown:
        raise SystemExit(f"no such query: {', '.join(unknown)}")
    folder.mkdir(parents=True, exist_ok=True)
    report = {"status": "running", "tables": tables, "against": against, "stages": []}
    for name in sorted(names):
        began, stage = time.monotonic(), {"name": name}
        try:
            path = f"{out}/results/{name}"
            catalog.QUERIES[name](spark, tables).write.parquet(path)
            got = spark.read.parquet(path)
            stage |= {"status": "ok", "rows": got.count()}
            if against:
                stage["differences"] = row_differences(got, spark.read.parquet(f"{against}/results/{name}"))
                stage["status"] = "different" if stage["differences"] else "ok"
        except Exception as e:  # a stage's failure is part of the report
            stage |= {"status": "failed", "error": str(e)[:2000]}
        report["stages"].append(stage | {"seconds": round(time.monotonic() - began, 2)})
        (folder / "report.json").write_text(json.dumps(report, indent=2) + "\n")
    report["status"] = "passed" if all(s["status"] == "ok" for s in report["stages"]) else "failed"
    (folder / "report.json").write_text(json.dumps(report, indent=2) + "\n")
    return report


def jobs(manifest: DataFrame, references: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """(sample_id, generated_path, reference_path) of the samples of a manifest with the chosen fields.

    manifest: workflow, model, shot, task_id, generated_path and perhaps sample_id; references: task_id, reference_path. An
    unknown or repeated task, a repeated sample, and an id that its fields don't give are errors."""
    known = scans.unique_rows(references.select("task_id", "reference_path"), "task_id")
    own = F.concat_ws("|", *IDENTITY)
    rows = scans.manifest(manifest, known, "task_id", **chosen)
    if "sample_id" in manifest.columns:
        bad = F.raise_error(F.concat(F.lit("sample id disagrees with its fields: "), F.col("sample_id"))).cast("string")
        own = F.when(F.coalesce("sample_id", F.lit("")) == "", own).when(F.col("sample_id") == own, own).otherwise(bad)
    return scans.unique_rows(rows.select(own.alias("sample_id"), "generated_path", "reference_path"), "sample_id")


def _texts(spark: SparkSession, work: list, column: str, as_: str) -> DataFrame:
    """(path, text) of the files that rows name."""
    paths = sorted({r[column] for r in work})
    found = scans.source_texts(spark, [os.path.abspath(p) if "://" not in p else p for p in paths])
    plain = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), r"\+", "%2B"))
    full = spark.createDataFrame([(p, os.path.abspath(p) if "://" not in p else p) for p in paths], "given string, full string")
    return full.join(found.select(plain.alias("full"), F.col("text").alias(as_)), "full").select(F.col("given").alias(column), as_)


def evaluate_dataset(spark: SparkSession, listed: DataFrame, out: str, outcomes: str | None = None, step: int = 500) -> int:
    """Score the samples that are not scored yet, step at a time; the number scored.

    Each step's scores are written under a number of their own when it is done, so a run that was stopped goes on with what
    is left; summary() reads all steps."""
    known = spark.read.schema(OUTCOMES).json(outcomes) if outcomes else spark.createDataFrame([], OUTCOMES)
    scores = Path(f"{out}/scores")
    finished = sorted(int(p.name.split("=")[1]) for p in scores.glob("batch=*") if (p / "_SUCCESS").exists()) if scores.exists() else []
    if finished:
        done = spark.read.parquet(*[f"{out}/scores/batch={k}" for k in finished]).select("name").distinct()
        listed = incremental.remaining(listed, done.withColumnRenamed("name", "sample_id"), ["sample_id"])
    number, total, after = max(finished, default=-1) + 1, 0, ""
    while True:
        # A step's rows name files to read, so their paths come here; there are step of them at most.
        work = listed.where(F.col("sample_id") > after).orderBy("sample_id").limit(step).collect()
        if not work:
            return total
        rows = spark.createDataFrame(work, "sample_id string, generated_path string, reference_path string")
        both = rows.join(_texts(spark, work, "generated_path", "gen"), "generated_path").join(_texts(spark, work, "reference_path", "ref"), "reference_path")
        both = both.select(F.col("sample_id").alias("name"), "gen", "ref")
        for s, text in (("generated", "gen"), ("ground", "ref")):
            own = known.where(F.col("side") == s).dropDuplicates(["name"]).drop("side")
            both = both.join(own.select("name", F.struct(*[c for c in own.columns if c != "name"]).alias("_e")), "name", "left")
            both = both.withColumn(s, registry.side({"text": F.col(text), **{k: F.col(f"_e.{k}") for k in EVIDENCE if k != "text"}})).drop("_e", text)
        registry.measured(both, "name").write.mode("overwrite").parquet(f"{out}/scores/batch={number}")
        number, total, after = number + 1, total + len(work), work[-1]["sample_id"]


def summary(spark: SparkSession, out: str) -> DataFrame:
    """The metrics over all scored samples of a data set."""
    return registry.summary(spark.read.parquet(f"{out}/scores").drop("batch"))
