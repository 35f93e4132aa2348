"""Many cases checked in one file: batches built to a limit, and diagnostics mapped back to cases by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.operators.joins import located
from trivane.operators.windows import running_sums

# What a batch begins and ends with, and messages of failed proofs.
HEAD = ("use vstd::prelude::*;",)
OPEN, CLOSE = ("", "verus! {"), ("", "} // verus!", "")
PROOF_ERRORS = ("postcondition not satisfied", "assertion failed", "arithmetic overflow", "arithmetic underflow", "underflow/overflow")


def batches(cases: DataFrame, unit: str, case: str, text: str, most: int, uses: tuple[str, ...] = (), preamble: tuple[str, ...] = ()) -> DataFrame:
    """(unit, batch, case, start, end, text): the cases of a unit in order, most to a batch, with their lines in its file.

    A blank line stands before every case. Positions in a unit of any size are spread over tasks; a batch is bounded."""
    lead = [*HEAD, *[u for u in uses if u and u not in HEAD], *OPEN, *(["", *preamble] if preamble else [])]
    numbered = running_sums(cases.select(unit, case, text).withColumn("_one", F.lit(1)), [unit], [case], {"_i": "_one"})
    lines = F.size(F.split(F.col(text), "\n", -1)).cast("long")
    own = numbered.withColumn("batch", F.floor(F.col("_i") / most)).withColumn("_l", lines)
    before = F.coalesce(F.sum(F.col("_l") + 1).over(W.partitionBy(unit, "batch").orderBy(case).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = F.lit(len(lead) + 2) + before
    return own.select(unit, "batch", case, start.cast("long").alias("start"), (start + F.col("_l") - 1).cast("long").alias("end"), text)


def files(built: DataFrame, unit: str, case: str, text: str, uses: tuple[str, ...] = (), preamble: tuple[str, ...] = ()) -> DataFrame:
    """(unit, batch, file): the text of each batch; the cases of one are as many as a batch holds."""
    lead = [*HEAD, *[u for u in uses if u and u not in HEAD], *OPEN, *(["", *preamble] if preamble else [])]
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(case).alias("c"), F.col(text).alias("t")))), lambda x: F.concat(F.lit("\n"), x["t"]))
    whole = F.concat_ws("\n", F.lit("\n".join(lead)), F.array_join(parts, "\n"), F.lit("\n".join(CLOSE)))
    return built.groupBy(unit, "batch").agg(whole.alias("file"))


def is_proof_error(message: Column) -> Column:
    return F.coalesce(message.rlike("|".join(PROOF_ERRORS)), F.lit(False))


def verdicts(built: DataFrame, runs: DataFrame, diagnostics: DataFrame, unit: str, case: str) -> DataFrame:
    """(unit, batch, case, success) from what running the batches gave.

    runs: (unit, batch, status ok, failed, timeout or unavailable, errors: how many proof errors the run counted or null).
    diagnostics: (unit, batch, id, message, line), a row for each place of an error. A case with a proof error in its lines
    fails; one with another error there is open; the others pass. All cases of a batch are open if it timed out or has no proof
    error, if fewer proof errors came through than were counted, or if an error lies in no case."""
    key = [unit, "batch"]
    d = diagnostics.where(~F.coalesce(F.contains("message", F.lit("aborting due to")), F.lit(False))).withColumn("_proof", is_proof_error(F.col("message")))
    seen = d.groupBy(*key).agg(F.countDistinct(F.when(F.col("_proof"), F.col("id"))).alias("_seen"))
    place = F.concat_ws("|", F.col(unit).cast("string"), F.col("batch").cast("string"))
    at = located(d.where("line IS NOT NULL").select(place.alias("_b"), "line", "_proof", *key), built.select(place.alias("_b"), "start", "end", case), "_b", "line", "start", "end", case)
    lost = at.groupBy(*key).agg(F.bool_or(F.col(case).isNull()).alias("_lost"))
    hit = at.where(F.col(case).isNotNull()).groupBy(*key, case).agg(F.bool_or("_proof").alias("_hit"))
    out = built.select(*key, case).join(runs, key, "left").join(seen, key, "left").join(lost, key, "left").join(hit, [*key, case], "left")
    n = F.coalesce("_seen", F.lit(0))
    open_ = (F.col("status") != "failed") | (n == 0) | F.coalesce(n < F.col("errors"), F.lit(False)) | F.coalesce("_lost", F.lit(False))
    success = F.when(F.col("status") == "ok", True).when(F.coalesce(open_, F.lit(True)), None).when(F.col("_hit"), False).when(F.col("_hit").isNull(), True)
    return out.select(*key, case, success.alias("success"))
