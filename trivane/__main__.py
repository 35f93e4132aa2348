"""Command line: list the queries, run one over a folder of tables, measure texts, check files, reproduce results.

    python -m trivane list
    python -m trivane run NAME TABLES [--out FOLDER]
    python -m trivane evaluate GENERATED REFERENCE [--out FOLDER] [--outcomes FILE] [--suffix .rs]
    python -m trivane dataset MANIFEST REFERENCES --out FOLDER [--workflow W] [--model M] [--shot S] [--task T] [--outcomes FILE] [--step N]
    python -m trivane validate FOLDER MANIFEST
    python -m trivane reproduce TABLES --out FOLDER [--only NAME ...] [--against FOLDER]

dataset scores the samples of a CSV manifest that are not scored yet; a stopped run goes on where it was. validate lists the files
that a manifest of hashes doesn't agree with. reproduce writes the results of queries, and compares them with those of an earlier run.

GENERATED and REFERENCE are two files, or two folders whose files of the same name are paired. FILE holds a JSON object a line:
name, side (generated or ground) and fields of evidence (see functions/metrics.py), for metrics that an outside program decides."""

from __future__ import annotations

import argparse
from pathlib import Path


def file_pairs(generated: str, reference: str, suffix: str) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(name, generated, reference) of two files, or of the files of the same name in two folders; and names without a partner."""
    g, r = Path(generated), Path(reference)
    if g.is_file() and r.is_file():
        return [(g.name, str(g), str(r))], []
    if not g.is_dir() or not r.is_dir():
        raise SystemExit("give two files or two folders")
    own, theirs = ({f.name for f in d.iterdir() if f.suffix == suffix} for d in (g, r))
    if not own & theirs:
        raise SystemExit(f"no {suffix} files of the same name: {len(own)} generated, {len(theirs)} reference")
    return [(n, str(g / n), str(r / n)) for n in sorted(own & theirs)], sorted(own ^ theirs)


def evaluate(generated: str, reference: str, out: str | None = None, outcomes: str | None = None, suffix: str = ".rs") -> None:
    """All metrics of the pairs, one JSON line each, or with out as Parquet (scores) and JSON (summary) in that folder."""
    import sys

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from trivane.functions import registry
    from trivane.functions.metrics import EVIDENCE

    pairs, alone = file_pairs(generated, reference, suffix)
    if alone:
        print(f"without a partner, skipped: {', '.join(alone)}", file=sys.stderr)
    spark = SparkSession.builder.appName("trivane").getOrCreate()
    read = lambda paths, as_: spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"), F.col("value").alias(as_))
    names = {Path(x).name: n for n, *two in pairs for x in two}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    texts = [read([p[k + 1] for p in pairs], s).select(label[F.url_decode("_file")].alias("name"), s) for k, s in enumerate(("gen", "ref"))]
    both = texts[0].join(texts[1], "name")
    fields = ", ".join(f"{k} {t}" for k, t in EVIDENCE.items() if k != "text")
    known = spark.read.schema(f"name string, side string, {fields}").json(outcomes) if outcomes else spark.createDataFrame([], f"name string, side string, {fields}")
    for s, text in (("generated", "gen"), ("ground", "ref")):
        own = known.where(F.col("side") == s).dropDuplicates(["name"]).drop("side")
        both = both.join(own.select("name", F.struct(*[c for c in own.columns if c != "name"]).alias("_e")), "name", "left")
        both = both.withColumn(s, registry.side({"text": F.col(text), **{k: F.col(f"_e.{k}") for k in EVIDENCE if k != "text"}})).drop("_e", text)
    scores = registry.measured(both, "name")
    if out:
        scores.write.mode("errorifexists").parquet(f"{out}/scores")
        scores = spark.read.parquet(f"{out}/scores")
        registry.summary(scores).coalesce(1).write.mode("errorifexists").json(f"{out}/summary")
    for row in (registry.summary(scores) if out else scores).orderBy("name" if not out else "metric").toJSON().toLocalIterator():
        print(row)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="trivane", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out")
    ev = sub.add_parser("evaluate")
    ev.add_argument("generated")
    ev.add_argument("reference")
    ev.add_argument("--out")
    ev.add_argument("--outcomes")
    ev.add_argument("--suffix", default=".rs")
    ds = sub.add_parser("dataset")
    ds.add_argument("manifest")
    ds.add_argument("references")
    ds.add_argument("--out", required=True)
    for name in ("workflow", "model", "shot", "task"):
        ds.add_argument(f"--{name}")
    ds.add_argument("--outcomes")
    ds.add_argument("--step", type=int, default=500)
    va = sub.add_parser("validate")
    va.add_argument("folder")
    va.add_argument("manifest")
    re = sub.add_parser("reproduce")
    re.add_argument("tables")
    re.add_argument("--out", required=True)
    re.add_argument("--only", nargs="*")
    re.add_argument("--against")
    a = p.parse_args(argv)
    if a.command == "evaluate":
        evaluate(a.generated, a.reference, a.out, a.outcomes, a.suffix)
        return
    from trivane import catalog

    if a.command in ("dataset", "validate", "reproduce"):
        from pyspark.sql import SparkSession

        from trivane import commands

        spark = SparkSession.builder.appName("trivane").getOrCreate()
        if a.command == "validate":
            bad = commands.file_differences(spark, a.folder, a.manifest).orderBy("path")
            n = 0
            for row in bad.toJSON().toLocalIterator():
                print(row)
                n += 1
            if n:
                raise SystemExit(1)
        elif a.command == "reproduce":
            report = commands.reproduce(spark, a.tables, a.out, a.only or list(catalog.QUERIES), a.against)
            print(f"{report['status']}: {len(report['stages'])} queries")
            if report["status"] != "passed":
                raise SystemExit(1)
        else:
            read = lambda path: spark.read.csv(path, header=True, multiLine=True, escape='"')
            chosen = {"workflow": a.workflow, "model": a.model, "shot": a.shot, "task_id": a.task}
            listed = commands.jobs(read(a.manifest), read(a.references), chosen)
            if listed.isEmpty():
                raise SystemExit("no samples selected")
            commands.evaluate_dataset(spark, listed, a.out, a.outcomes, a.step)
            for row in commands.summary(spark, a.out).orderBy("metric").toJSON().toLocalIterator():
                print(row)
        return

    if a.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    from pyspark.sql import SparkSession

    df = catalog.QUERIES[a.name](SparkSession.builder.appName("trivane").getOrCreate(), a.tables)
    if a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
