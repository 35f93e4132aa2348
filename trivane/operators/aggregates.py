"""Aggregations with explicit denominators. Counts are longs; grids are dense where a missing cell means zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.functions.states import all_true, long_if, ratio


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def population(df: DataFrame, *distinct: str) -> DataFrame:
    """One row: the number of rows and of distinct values of some columns."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.countDistinct(c).alias(f"n_{c}") for c in distinct])


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def densify(agg: DataFrame, dims: list[DataFrame], keys: list[str], zero: list[str]) -> DataFrame:
    """Every combination of the dims' rows, with zeros where agg has none. The dims are small: their grid is the result."""
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.crossJoin(d)
    return grid.join(agg, keys, "left").fillna(0, zero)


def mean_coverage(long: DataFrame, keys: list[str], value: str, eligible: Column) -> DataFrame:
    """Mean over known values with n, total, eligible, excluded, missing and coverage = n / eligible."""
    v = F.col(value)
    out = long.groupBy(*keys).agg(F.sum(v).alias("_s"), F.count(v).alias("n"), F.count(F.lit(1)).alias("total"), long_if(eligible).alias("eligible"), long_if(eligible & v.isNull()).alias("missing"))
    out = out.withColumn("mean", ratio("_s", "n")).withColumn("excluded", F.col("total") - F.col("eligible"))
    return out.withColumn("coverage", ratio("n", "eligible")).drop("_s")


def with_grand_total(df: DataFrame, keys: list[str], aggs: list[Column], label: str = "ALL") -> DataFrame:
    """Groups by keys and one more row for all, whose keys are label; one pass, by grouping sets."""
    cols = [F.col(k) for k in keys]
    out = df.groupingSets([cols, []], *cols).agg(F.grouping_id().alias("_g"), *aggs)
    return out.select(*[F.when(F.col("_g") > 0, label).otherwise(F.col(k)).alias(k) for k in keys], *[c for c in out.columns if c not in (*keys, "_g")])


def scoped(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Each row once for every scope that it belongs to, in a column scope."""
    tags = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in scopes.items()]), lambda x: x.isNotNull())
    return df.withColumn("scope", F.explode(tags))


def signal_rollup(df: DataFrame, signals: list[str], label: str, values: list[str]) -> DataFrame:
    """A row for each signal column: rows that have it, and how many of these carry each label value."""
    long = df.select(label, *signals).unpivot([label], signals, "signal", "on").groupBy("signal")
    on = F.col("on")
    return long.agg(long_if(on).alias("n"), *[long_if(on & (F.col(label) == v)).alias(v) for v in values])


#: Ranks that a sketch of a group may be off by are a share of 1 / ACCURACY of its rows.
ACCURACY = 10_000


def summary_statistics(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """mean, median, sample deviation (0 for one value), extremes, and quartiles by index: the values at floor(n/4) and
    floor(3n/4) of the sorted ones, not interpolated.

    Values at ranks are selected by counting: a sketch of each group brackets them, rows below a bracket are counted, and
    only within the brackets values are told apart and put in order, a few thousandths of a group at most (small groups'
    sketches are exact). No group's rows are sorted or gathered."""
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    v, n = F.col("_v"), F.col("_n")
    shares = [(p - 2 / ACCURACY, p + 2 / ACCURACY) for p in (0.25, 0.5, 0.75)]
    one = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_dev"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.percentile_approx(v, [x for pair in shares for x in pair], ACCURACY).alias("_q"),
    )
    # For each bracket its ends and the ranks, from 0, of the values that it must hold.
    wanted = [(F.floor(n / 4), F.floor(n / 4)), (F.floor((n - 1) / 2), F.floor(n / 2)), (F.floor(3 * n / 4), F.floor(3 * n / 4))]
    bracket = lambda i: F.struct(F.lit(i).alias("i"), F.col("_q")[2 * i].alias("low"), F.col("_q")[2 * i + 1].alias("high"), wanted[i][0].alias("r"), wanted[i][1].alias("s"))
    marks = one.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.array(*[bracket(i) for i in range(3)]).alias("_b"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)] or F.lit(True)
    # A row counts once for every bracket that it is not above; below a bracket its value doesn't matter.
    rows = known.join(marks, same).select(*keys, "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["high"])).alias("_b"))
    counts = rows.groupBy(*keys, F.col("_b.i").alias("_i"), F.when(v >= F.col("_b.low"), v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_b.r").alias("_r"), F.first("_b.s").alias("_s"))
    run = W.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("_to", F.sum("_c").over(run))
    holds = lambda rank: (F.col("_to") - F.col("_c") <= F.col(rank)) & (F.col(rank) < F.col("_to"))
    found = [F.max(F.when((F.col("_i") == i) & holds(rank), v)).alias(f"_{rank}{i}") for i in range(3) for rank in ("_r", "_s")]
    each = counts.groupBy(*keys).agg(*found).select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[f"_{rank}{i}" for i in range(3) for rank in ("_r", "_s")])
    value_at = lambda i, rank="_r": F.coalesce(f"_{rank}{i}", F.raise_error(F.lit("a sketch missed a rank")).cast(df.schema[value].dataType))

    out = one.join(each, same)
    return out.select(
        *keys,
        n.alias("scored"),
        F.round("_mean", digits).alias("mean"),
        F.round((value_at(1) + value_at(1, "_s")) / 2, digits).alias("median"),
        F.round(F.coalesce("_dev", F.lit(0.0)), digits).alias("stdev"),
        F.round("_min", digits).alias("min"),
        F.round("_max", digits).alias("max"),
        F.round(value_at(0), digits).alias("q25"),
        F.round(value_at(2), digits).alias("q75"),
    )


def tri_counts(df: DataFrame, keys: list[str], state: str, names: dict[str, str]) -> DataFrame:
    """Counts of the values of a state column as columns, and total."""
    return df.groupBy(*keys).agg(*[long_if(F.col(state) == v).alias(k) for k, v in names.items()], F.count(F.lit(1)).alias("total"))


def implication_rollup(clauses: DataFrame, unit: list[str]) -> DataFrame:
    """passed, failed, unknown and total over clauses with a verdict holds; score = passed / determined, coverage =
    determined / total, status ok, partial or not_available."""
    out = clauses.groupBy(*unit).agg(long_if(F.col("holds")).alias("passed"), long_if(~F.col("holds")).alias("failed"), long_if(F.col("holds").isNull()).alias("unknown"), F.count(F.lit(1)).alias("total"))
    known = F.col("passed") + F.col("failed")
    return out.select("*", ratio("passed", known).alias("score"), ratio(known, "total").alias("coverage"), F.when(known == 0, "not_available").when(F.col("unknown") > 0, "partial").otherwise("ok").alias("status"))


def strength(functions: DataFrame, unit: str) -> DataFrame:
    """Classification of a unit by its functions' two implications, forward and backward."""
    out = functions.groupBy(unit).agg(
        all_true(F.coalesce(F.col("forward"), F.lit(False))).alias("fwd"),
        all_true(F.coalesce(F.col("backward"), F.lit(False))).alias("bwd"),
        F.bool_or(F.col("status") != "ok").alias("open"),
        F.count(F.lit(1)).alias("functions"),
    )
    kind = F.when(F.col("fwd") & F.col("bwd"), "equivalent").when(F.col("fwd"), "generated_stronger_or_equal").when(F.col("bwd"), "generated_weaker_or_equal").when(F.col("open"), "unknown").otherwise("incomparable")
    return out.select(unit, "functions", kind.alias("classification"))


def case_scores(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of cases (state passed, failed or else unknown): score with unknowns as failures, score among the decided,
    and coverage."""
    out = cases.groupBy(*keys).agg(long_if(F.col("state") == "passed").alias("passed"), long_if(F.col("state") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))
    known = F.col("passed") + F.col("failed")
    return out.select("*", (F.col("total") - known).alias("unknown"), ratio("passed", "total").alias("score"), ratio("passed", known).alias("decidable_score"), ratio(known, "total").alias("coverage"))


def histogram_text(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group the counts of a value as text, `value=n` by value, joined by commas."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", F.col(value), F.col("n").cast("string"))))
    return each.groupBy(*keys).agg(F.array_join(parts, ",").alias("histogram"))


def kill_rate(mutants: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """killed / (killed + survived + unknown); invalid mutants are left out, unknown ones count as not killed."""
    o = F.col(outcome)
    out = mutants.groupBy(*keys).agg(*[long_if(o == v).alias(v) for v in ("killed", "survived", "unknown", "invalid_mutant")])
    valid = F.col("killed") + F.col("survived") + F.col("unknown")
    status = F.when(valid == 0, "not_available").when(F.col("unknown") > 0, "partial").otherwise("ok")
    return out.select("*", ratio("killed", valid).alias("score"), status.alias("status"))


def duplicate_rate(items: DataFrame, unit: str, text: str) -> DataFrame:
    """Share of items that repeat an earlier one of their unit."""
    each = items.groupBy(unit, text).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(unit).agg(F.sum(F.col("n") - 1).alias("extra"), F.sum("n").alias("total")).select(unit, "extra", "total", ratio("extra", "total").alias("rate"))


def flagged_rate(items: DataFrame, unit: str, flag: Column) -> DataFrame:
    return items.groupBy(unit).agg(long_if(flag).alias("flagged"), F.count(F.lit(1)).alias("total")).withColumn("rate", ratio("flagged", "total"))


def probe_rate(probes: DataFrame, unit: str) -> DataFrame:
    """always_false / checked with a status: not_available if nothing was checked, partial if some were not."""
    out = probes.groupBy(unit).agg(long_if(F.col("always_false")).alias("flagged"), F.count("always_false").alias("checked"), F.count(F.lit(1)).alias("total"))
    status = F.when(F.col("checked") == 0, "not_available").when(F.col("checked") < F.col("total"), "partial").otherwise("ok")
    return out.select("*", ratio("flagged", "checked").alias("rate"), status.alias("status"))


def structure_rollup(clauses: DataFrame, unit: str) -> DataFrame:
    """Sum of nodes, largest depth, distinct operators, and the share of clauses that were analysed (1 for none)."""
    one = clauses.groupBy(unit).agg(F.sum(F.when(F.col("ok"), F.col("nodes"))).alias("nodes"), F.max(F.when(F.col("ok"), F.col("depth"))).alias("depth"), long_if(F.col("ok")).alias("analysed"), F.count(F.lit(1)).alias("total"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("operators")))).alias("_ops"))
    return one.select(unit, F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("depth", F.lit(0)).alias("depth"), F.array_join("_ops", " ").alias("operators"), F.coalesce(ratio("analysed", "total"), F.lit(1.0)).alias("coverage"))


def pivot_counts(items: DataFrame, unit: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts by kind as columns, zero-filled, and their total; the kinds are given, so one pass is enough."""
    return items.groupBy(unit).agg(*[long_if(F.col(kind) == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


def deficits(df: DataFrame, key: str, checks: dict[str, Column], first: int = 20) -> DataFrame:
    """Per check: rows that show it, their share, and the first keys in order (as text, at most first)."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    flags = scoped(df.select(key, *[c.alias(k) for k, c in checks.items()]), {k: F.col(k) for k in checks}).select(key, F.col("scope").alias("deficit"))
    rank = F.row_number().over(W.partitionBy("deficit").orderBy(key))
    flags = flags.withColumn("_r", rank)
    out = flags.groupBy("deficit").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= first, F.col(key)))), ",").alias("files"))
    return out.crossJoin(total).select("deficit", "n", F.round(ratio("n", "_total"), 4).alias("rate"), "files")


def combination_shares(df: DataFrame, flags: list[str]) -> DataFrame:
    """Counts of the combinations of flags with their share of all."""
    out = df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", ratio("n", F.sum("n").over(W.partitionBy())))


def merged_cases(cases: DataFrame, identity: list[str], expected: str, unexpected: str, pos: str) -> DataFrame:
    """One row per identity: its unexpected values, each once, in first order, without the expected one."""
    first = cases.where(~F.col(unexpected).eqNullSafe(F.col(expected))).groupBy(*identity, expected, unexpected).agg(F.min(pos).alias("_p"))
    one = cases.groupBy(*identity, expected).agg(F.min(pos).alias("first_pos"))
    lists = first.groupBy(*identity, expected).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", unexpected))), lambda x: x[unexpected].cast("string")), ",").alias("unexpected"))
    return one.join(lists, [*identity, expected], "left").fillna("", ["unexpected"])
