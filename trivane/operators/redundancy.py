"""Which clauses of a program can be deleted together, from a table of verdicts: a fix-point over tables.

Outside programs decide deletions; what they found is a table with a row for each set of deleted clauses that was tried. The
search over these verdicts is the same for all programs at once: every step looks up one set for each clause still in question
of each program still open, by an equi join, and no program is ever gathered as a group. Steps:

1. each clause alone: removable if the rest verifies; necessary if the rest fails although the front end accepts it;
   unknown otherwise (the front end rejects it, a timeout, no verdict at all);
2. all removable clauses at once;
3. from there on the first clause, in order, without which the rest still verifies goes, until none does.

Every look-up is an attempt, asking the front end after a failure is another one, and a program's attempts are bounded by
its budget; what was not attempted stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.session import stored

VERIFIED, FAILED = "verified", "proof_failed"


def set_key(ids: Column) -> Column:
    """The name of a set of clauses in the table of verdicts: its numbers in order, joined by commas."""
    return F.array_join(F.array_sort(ids), ",")


def budget(candidates: Column, most: int = 60) -> Column:
    """Attempts that a program with so many clauses in question may take."""
    return F.greatest(F.lit(most), 3 * candidates + 4)


def single_deletions(candidates: DataFrame, verdicts: DataFrame, unit: str, attempts: Column | None = None) -> DataFrame:
    """(unit, id, before, outcome, cost, limit) of each clause alone; outcome is null where the budget ended before.

    candidates: (unit, id long), in the order of id. verdicts: (unit, removed, outcome, frontend): the set's name, the
    run's outcome, and whether the front end accepts what is left (asked after FAILED only)."""
    n = F.count(F.lit(1)).over(W.partitionBy(unit))
    one = candidates.select(unit, "id", (attempts if attempts is not None else budget(n)).cast("long").alias("limit"))
    one = one.withColumn("removed", F.col("id").cast("string")).join(verdicts, [unit, "removed"], "left")
    needs = F.coalesce(F.col("outcome") == FAILED, F.lit(False))
    # Attempts are cut off at the end only, so those before a clause are the sum of the full costs.
    before = F.coalesce(F.sum(F.when(needs, 2).otherwise(1)).over(W.partitionBy(unit).orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("_needs", needs).withColumn("before", before.cast("long"))
    asked = F.col("_needs") & (F.col("before") + 1 < F.col("limit"))
    result = F.when(F.col("outcome") == VERIFIED, "removable").when(asked & F.coalesce("frontend", F.lit(False)), "necessary").otherwise("unknown")
    tried = F.col("before") < F.col("limit")
    return one.select(unit, "id", "before", F.when(tried, result).alias("outcome"), F.when(tried, 1 + asked.cast("long")).otherwise(0).alias("cost"), (tried & asked).cast("long").alias("checks"), "limit")


def minimised(programs: DataFrame, candidates: DataFrame, verdicts: DataFrame, unit: str, attempts: Column | None = None) -> DataFrame:
    """One row per program: status, score, coverage, strategy, clauses, removed, necessary, unknown, minimal_size, attempts,
    frontend_checks and removed_ids in order of removal.

    status: skipped (the program itself doesn't verify), no_testable_clauses, partial (something unknown, or the budget
    used up) or ok. score is removed / clauses, coverage the share of clauses that are not unknown.

    The rounds run here, each a job over the programs still open; a round's table is written to the shared folder and
    takes the place of the one before."""
    base = verdicts.where("removed = ''").select(unit, (F.col("outcome") == VERIFIED).alias("_base"))
    single = single_deletions(candidates.join(base.where("_base"), unit, "left_semi"), verdicts, unit, attempts)
    pick = lambda name: F.array_sort(F.collect_list(F.when(F.col("outcome") == name, F.col("id"))))
    state = single.groupBy(unit).agg(
        F.array_sort(F.collect_list("id")).alias("ids"),
        pick("removable").alias("removable"),
        pick("necessary").alias("necessary"),
        F.sum("cost").alias("used"),
        F.sum("checks").alias("checks"),
        F.max("limit").alias("limit"),
    )
    # All removable clauses at once.
    joint = state.withColumn("removed", set_key(F.col("removable"))).join(verdicts.select(unit, "removed", F.col("outcome").alias("_joint")), [unit, "removed"], "left")
    tried = (F.size("removable") > 0) & (F.col("used") < F.col("limit"))
    hit = tried & F.coalesce(F.col("_joint") == VERIFIED, F.lit(False))
    none = F.array().cast("array<bigint>")
    state = joint.select(unit, "ids", "necessary", "checks", "limit", F.when(hit, F.col("removable")).otherwise(none).alias("gone"), hit.alias("optimistic"), F.lit(False).alias("greedy"), (F.col("used") + tried.cast("long")).alias("used"), (F.size("removable") > 0).alias("open"))
    state = stored(state.withColumn("open", F.col("open") & (F.col("used") < F.col("limit"))), "minimise")
    finished = []
    while not state.where("open").isEmpty():
        finished.append(state.where("NOT open"))
        now = state.where("open")
        left = F.array_except("ids", "gone")
        ask = now.select(unit, "gone", F.posexplode(F.slice(left, F.lit(1), (F.col("limit") - F.col("used")).cast("int"))).alias("_at", "_id"))
        ask = ask.withColumn("removed", set_key(F.array_append("gone", F.col("_id"))))
        found = ask.join(verdicts.where(F.col("outcome") == VERIFIED).select(unit, "removed"), [unit, "removed"]).groupBy(unit).agg(F.min(F.struct("_at", "_id")).alias("_f"))
        step = now.join(found, unit, "left").withColumn("_n", F.least(F.size(left), F.col("limit") - F.col("used")))
        go = F.col("_f").isNotNull()
        step = step.select(
            unit, "ids", "necessary", "checks", "limit",
            F.when(go, F.array_append("gone", F.col("_f._id"))).otherwise(F.col("gone")).alias("gone"),
            "optimistic", (F.col("greedy") | go).alias("greedy"),
            F.when(go, F.col("used") + F.col("_f._at") + 1).otherwise(F.col("used") + F.col("_n")).cast("long").alias("used"),
            go.alias("open"),
        )
        step = step.withColumn("open", F.col("open") & (F.col("used") < F.col("limit")) & (F.size("gone") < F.size("ids")))
        state = stored(step, "minimise")
    for rows in finished:
        state = state.unionByName(rows)
    n = F.size("ids").cast("long")
    removed = F.size("gone").cast("long")
    unknown = F.size(F.array_except("ids", F.array_union("gone", F.array_union("necessary", "removable_ids")))).cast("long")
    definite = single.where("outcome = 'removable'").groupBy(unit).agg(F.collect_list("id").alias("removable_ids"))
    out = state.join(definite, unit, "left").withColumn("removable_ids", F.coalesce("removable_ids", none)).withColumn("unknown", unknown)
    used_up = F.col("used") >= F.col("limit")
    strategy = F.concat_ws("+", F.when(F.col("optimistic"), "optimistic"), F.when(F.col("greedy"), "greedy"))
    out = out.select(
        unit, F.when((F.col("unknown") > 0) | used_up, "partial").otherwise("ok").alias("status"), (removed / n).alias("score"), ((n - F.col("unknown")) / n).alias("coverage"),
        F.when(strategy == "", "none").otherwise(strategy).alias("strategy"), n.alias("clauses"), removed.alias("removed"), (n - F.col("unknown") - removed).alias("necessary"),
        "unknown", (n - removed).alias("minimal_size"), F.col("used").alias("attempts"), F.col("checks").alias("frontend_checks"), F.array_join("gone", ",").alias("removed_ids"),
    )
    # Programs that don't verify, or without a clause in question.
    sizes = candidates.groupBy(unit).agg(F.count(F.lit(1)).alias("clauses"))
    rest = programs.select(unit).join(base, unit, "left").join(sizes, unit, "left").withColumn("clauses", F.coalesce("clauses", F.lit(0)))
    fails = ~F.coalesce("_base", F.lit(False))
    rest = rest.where(fails | (F.col("clauses") == 0))
    zero, text = F.lit(0).cast("long"), F.lit(None).cast("string")
    rest = rest.select(
        unit, F.when(fails, "skipped").otherwise("no_testable_clauses").alias("status"), F.when(~fails, 0.0).alias("score"), F.lit(None).cast("double").alias("coverage"),
        text.alias("strategy"), "clauses", zero.alias("removed"), zero.alias("necessary"), zero.alias("unknown"), F.col("clauses").alias("minimal_size"), zero.alias("attempts"),
        zero.alias("frontend_checks"), F.lit("").alias("removed_ids"),
    )
    return out.unionByName(rest)
