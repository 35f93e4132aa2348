"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions alone.

Each row has a hash of its id and text. A source's budget is met by the rows whose hash lies below a threshold, which
histograms find: sum the sizes by source and hash bucket, locate the bucket in which the budget ends, and refine that bucket
alone. Four levels of 12, 12, 12 and 16 bits end at one hash value; nothing is sorted. Of rows that share that value (repeats
of one row) as many are taken as come nearest to the budget. A budget over the whole source means whole repeats and a
threshold for the rest, so thresholds of growing budgets are nested.

Null texts have size 0, a null source is a source of its own (last), rows without an id are told apart by their texts, an
empty table gives an empty result. Extra columns are not read, but for choosing among rows repeated with other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.llm.common import stored
from trivane.operators.windows import positions, running_sums

WORD = r"[^\x20\x09-\x0D]+"
#: A source's target stops at so many times its size.
MOST = 3
HASH_BITS, LEVELS = 52, (40, 28, 16, 0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash52(doc_id: Column, text: Column) -> Column:
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit("mix"), F.coalesce(F.md5(text.cast("binary")), F.lit("~")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with w (1, 2, 3 repeating by code point, null last) and target.

    Water filling: in the order of MOST * size / w the first k sources stop at their limit and the rest share what is left
    by weight; k is the first for which the next source stays below its limit. The order and the sums up to a source are
    found by range, so that there may be any number of sources; single values come to the driver."""
    s = positions(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_rank")
    s = s.withColumn("w", ((F.col("_rank") - 1) % 3 + 1).cast("long"))
    s = s.withColumn("limit", (F.col("source_size") * MOST).cast("long")).withColumn("r", F.col("limit").cast("double") / F.col("w"))
    s = running_sums(s, [], ["r", "_last", "source"], {"_full": "limit", "_spent": "w"})
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    # lam of a row: the level when all rows before it have stopped. It holds at the first row that it doesn't fill.
    s = s.withColumn("lam", (F.lit(total["size"]) - F.col("_full")).cast("double") / (F.lit(total["w"]) - F.col("_spent")))
    level = s.where("lam <= r").agg(F.min_by("lam", F.struct("r", "_last", "source"))).first()[0]
    return s.select("source", "source_size", "w", F.least(F.col("limit").cast("double"), F.lit(level or 0.0) * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """For each source of budget (source, need): the hash cut at which its budget ends, the rows there (at_cut), and how many
    of these to take so that they and the rows with _h < cut come nearest to need."""
    state = budget.select(F.col("source").alias("_s"), F.col("need").alias("_need"), F.lit(0).cast("long").alias("_prefix"))
    at = HASH_BITS
    for shift in LEVELS:
        inside = rows.join(state, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", at) == F.col("_prefix")))
        hist = inside.groupBy("_s", "_need", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        run = W.partitionBy("_s").orderBy("_bucket")
        hist = hist.withColumn("_cum", F.sum("_sum").over(run))
        # The first bucket that passes the need; it exists, as the bucket before refinement passed it.
        cut = hist.where(F.col("_cum") > F.col("_need")).groupBy("_s").agg(F.min(F.struct("_bucket", "_cum", "_sum", "_need", "_n")).alias("x"))
        state = cut.select("_s", (F.col("x._need") - (F.col("x._cum") - F.col("x._sum"))).alias("_need"), F.col("x._bucket").alias("_prefix"), F.col("x._sum").alias("_sum"), F.col("x._n").alias("_n"))
        state = stored(state, "cut")
        at = shift
    take = F.floor(F.col("_need") * F.col("_n") / F.col("_sum") + 0.5).cast("long")
    return state.select(F.col("_s").alias("source"), F.col("_prefix").alias("cut"), F.col("_n").alias("at_cut"), take.alias("take"))


def _rules(rows: DataFrame) -> DataFrame:
    """For each source _s: source_size, target, base repeats, and the rows that earn one more: those with a hash below cut, and
    take of the at_cut rows at it."""
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = goal.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("need", F.col("target") - F.col("base") * F.col("source_size")), "goal")
    thr = thresholds(rows, goal.where("source_size > 0 and need > 0")).select(F.col("source").alias("_t"), "cut", "at_cut", "take")
    goal = goal.join(thr, F.col("source").eqNullSafe(F.col("_t")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cut", "at_cut", "take")]
    return stored(goal.select(F.col("source").alias("_s"), "source_size", "target", "base", *zero), "rules")


def _copies(rows: DataFrame, rules: DataFrame, tie: Column) -> DataFrame:
    """rows (with _source and _h) and their rules, with copies. Rows that share the hash at a cut are numbered, by tie."""
    out = rows.join(rules, F.col("_source").eqNullSafe(F.col("_s")))
    split = "take > 0 AND take < at_cut"
    below = (F.col("_h") < F.col("cut")) | ((F.col("_h") == F.col("cut")) & (F.col("take") > 0))
    if rules.where(split).isEmpty():
        return out.withColumn("copies", (F.col("base") + below.cast("int")).cast("long"))
    at = out.where(f"{split} AND _h = cut").withColumn("_last", F.col("_source").isNull()).withColumn("_tie", tie).withColumn("_n", F.monotonically_increasing_id())
    at = running_sums(at.withColumn("_one", F.lit(1)), ["_last", "_source"], ["_tie", "_n"], {"_before": "_one"})
    at = at.withColumn("copies", (F.col("base") + (F.col("_before") < F.col("take")).cast("int")).cast("long"))
    rest = out.where(f"NOT ({split} AND _h = cut)").withColumn("copies", (F.col("base") + below.cast("int")).cast("long"))
    return rest.unionByName(at.select(*rest.columns))


def _narrow(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), hash52(F.col("doc_id").cast("long"), F.col("text")).alias("_h"))
    return stored(rows, "sizes")


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and copies of every row."""
    rows = _narrow(documents)
    out = _copies(rows.withColumn("_source", F.col("source")), _rules(rows), F.lit(0))
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(documents: DataFrame) -> DataFrame:
    """The rows of documents, all their columns kept, each as often as the mix takes it."""
    rules = _rules(_narrow(documents)).select("_s", "base", "cut", "at_cut", "take")
    # The rows travel as one struct, so that no column of theirs can clash with a name used here.
    rows = documents.select(F.struct("*").alias("_row"), F.col("source").cast("string").alias("_source"), hash52(F.col("doc_id").cast("long"), F.col("text")).alias("_h"))
    out = _copies(rows, rules, F.xxhash64(F.to_json("_row")))
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")
