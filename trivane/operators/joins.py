"""Joins with the guarantees that evidence needs: keys checked, missing sides given a meaning, pairs enumerated by rule."""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from trivane.session import gathered, ship


def checked_join(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """1:1 join in which every left row must find its partner; a missing one is an error when the row is read."""
    keys = [on] if isinstance(on, str) else on
    out = left.join(right.withColumn("_found", F.lit(True)), keys, "left")
    checked = F.when(F.col("_found"), F.col(keys[0])).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.col(keys[0]).cast("string"))).cast(left.schema[keys[0]].dataType))
    return out.withColumn(keys[0], checked).drop("_found")


def star(fact: DataFrame, *dims: tuple[DataFrame, str]) -> DataFrame:
    """Inner joins of a fact with its dimensions, each on one key; sizes decide on broadcasts."""
    for dim, key in dims:
        fact = fact.join(dim, key)
    return fact


def left_with_defaults(left: DataFrame, right: DataFrame, on: str | list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join; columns of right that found nothing, or null there, take their default."""
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def against_store(work: DataFrame, store: DataFrame, key: str, version: str, status: str = "status", missing: str = "not_attempted") -> DataFrame:
    """Work with its stored status; results of another version count as missing."""
    s = store.select(F.col(key).alias("_k"), F.col(version).alias("_v"), F.col(status).alias("_s"))
    out = work.join(s, (F.col(key) == F.col("_k")) & (F.col(version) == F.col("_v")), "left")
    return out.withColumn(status, F.coalesce("_s", F.lit(missing))).drop("_k", "_v", "_s")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side; empty if the key sets are equal."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).distinct().withColumn("_b", F.lit(True))
    out = x.join(y, key, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull())
    return out.select(key, F.when(F.col("_a"), "left").otherwise("right").alias("side"))


def paired(df: DataFrame, unit: list[str], side: str, left: str, right: str, value: str) -> DataFrame:
    """Values of two sides of a unit next to each other, by conditional aggregation and not by a self join; both known."""
    pick = lambda s: F.max(F.when(F.col(side) == s, F.col(value)))
    out = df.where(F.col(side).isin(left, right)).groupBy(*unit).agg(pick(left).alias("left"), pick(right).alias("right"))
    return out.where(F.col("left").isNotNull() & F.col("right").isNotNull())


def oriented_pairs(items: DataFrame, order: Column, rules: dict[str, Callable[[str, str], Column]], first: Callable[[str, str, str], Column] | None = None) -> DataFrame:
    """Unordered pairs of a few items (configurations, models) that a rule relates: rule, l.*, r.*; the first rule that
    holds names the pair, and first(rule, l, r) says whether to turn it around."""
    left, right = items.withColumn("_o", order).alias("l"), items.withColumn("_o", order).alias("r")
    name = F.coalesce(*[F.when(rule("l", "r"), F.lit(k)) for k, rule in rules.items()])
    out = left.join(right, F.col("l._o") < F.col("r._o")).withColumn("rule", name).where("rule IS NOT NULL")
    swap = first("rule", "l", "r") if first else F.lit(False)
    cols = items.columns
    picks = [F.when(swap, F.col(f"{b}.{c}")).otherwise(F.col(f"{a}.{c}")).alias(f"{p}_{c}") for a, b, p in (("l", "r", "left"), ("r", "l", "right")) for c in cols]
    return out.select("rule", *picks)


def common_units(df: DataFrame, unit: str, side: str, left: str, right: str, cond: Column) -> DataFrame:
    """Units for which the condition holds on both sides."""
    ok = df.where(cond & F.col(side).isin(left, right)).groupBy(unit).agg(F.countDistinct(side).alias("_n"))
    return ok.where("_n = 2").select(unit)


def last_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row per key, the last by position."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(pos)))).where("_r = 1").drop("_r")


def reference_left(ref: DataFrame, gen: DataFrame, on: str | list[str], verdict: str) -> DataFrame:
    """Reference rows with their generated match; without one the verdict is false, and matched tells the difference to an
    unknown verdict of a match."""
    out = ref.join(gen.withColumn("_m", F.lit(True)), on, "left")
    return out.withColumn(verdict, F.when(F.col("_m").isNull(), False).otherwise(F.col(verdict))).withColumn("matched", F.col("_m").isNotNull()).drop("_m")


def resolve_names(calls: DataFrame, names: DataFrame, call: str, name: str, pos: str, sep: str = "::") -> DataFrame:
    """Calls with the name that they mean: an equal one, else the first whose last path segment is the call's.

    Two equi joins instead of a suffix comparison of all pairs."""
    exact = names.groupBy(name).agg(F.min(pos).alias("_p")).select(F.col(name).alias("_e"))
    tail = F.element_at(F.split(F.col(name), sep), -1)
    by_tail = names.groupBy(tail.alias("_t")).agg(F.min_by(name, pos).alias("_s"))
    out = calls.join(exact, F.col(call) == F.col("_e"), "left").join(by_tail, F.element_at(F.split(F.col(call), sep), -1) == F.col("_t"), "left")
    return out.withColumn("resolved", F.coalesce("_e", "_s")).drop("_e", "_t", "_s")


def by_position(left: DataFrame, right: DataFrame, unit: str, a: str, b: str) -> DataFrame:
    """Elements of two arrays of a unit side by side; pos from 0, null where one is shorter."""
    x = left.join(right, unit)
    zipped = F.arrays_zip(F.col(a).alias("l"), F.col(b).alias("r"))
    return x.select(unit, F.posexplode(zipped).alias("pos", "_z")).select(unit, F.col("pos").cast("long").alias("pos"), F.col("_z")["l"].alias("left"), F.col("_z")["r"].alias("right"))


def work_list(dims: list[DataFrame], done: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of small dimensions that is not done yet."""
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.crossJoin(d)
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def ordered_match(left: DataFrame, right: DataFrame, unit: str, keys: list[str], pos: str) -> DataFrame:
    """(unit, matched, complete, pairs): the items of one side found in order among those of the other, by unit of the left.

    A cursor goes along the right side: each left item, in the order of pos, takes the next equal item after the one
    taken before; the first left item that finds none ends the match. pairs are structs of left_pos and right_pos.
    Both sides of a unit meet in one task, as a hash and a position for each item, in one sorted stream: the right ones'
    places are kept by item and searched by halves, the left ones only pass by."""
    spark = left.sparkSession
    ship(spark)
    side = lambda df, n: df.select(F.col(unit).alias("_u"), F.lit(n).alias("_s"), F.xxhash64(*keys).alias("_k"), F.col(pos).cast("long").alias("_p"))
    # Units that only the right side has give no row, and need not be moved.
    theirs = side(right, 0).join(left.select(F.col(unit).alias("_u")).distinct(), "_u", "left_semi")
    both = side(left, 1).unionByName(theirs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = gathered(both, n, "_u").sortWithinPartitions("_u", "_s", "_p").select("_u", "_s", "_k", "_p")
    kind = pa.list_(pa.struct([("left_pos", pa.int64()), ("right_pos", pa.int64())]))
    of_unit = to_arrow_type(left.schema[unit].dataType)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        unit_now, seen = None, False
        places: dict[int, list[int]] = {}
        at: list[int] = []
        cursor, lefts, pairs = 0, 0, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in out], of_unit), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out]), pa.array([r[3] for r in out], kind)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[unit, "matched", "complete", "pairs"])

        for b in batches:
            for u, s, k, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not seen or u != unit_now:
                    if lefts:
                        out.append((unit_now, len(pairs), len(pairs) == lefts, pairs))
                    unit_now, seen = u, True
                    places, at, cursor, lefts, pairs = {}, [], 0, 0, []
                if not s:
                    places.setdefault(k, []).append(len(at))
                    at.append(p)
                    continue
                lefts += 1
                if len(pairs) == lefts - 1:
                    own = places.get(k, ())
                    j = bisect_left(own, cursor)
                    if j < len(own):
                        pairs.append({"left_pos": p, "right_pos": at[own[j]]})
                        cursor = own[j] + 1
            if len(out) >= 4096:
                yield flush()
        if lefts:
            out.append((unit_now, len(pairs), len(pairs) == lefts, pairs))
        if out:
            yield flush()

    schema = f"`{unit}` {left.schema[unit].dataType.simpleString()}, matched long, complete boolean, pairs array<struct<left_pos:long,right_pos:long>>"
    return both.mapInArrow(fold, schema)


def similar_sets(items: list[tuple[int, str, list[str]]], threshold: float) -> Iterator[tuple[int, int, float]]:
    """(left_pos, right_pos, jaccard) of the items (pos, text, tokens) with different texts and sets as similar as that.

    Prefix filter: two such sets share one of the first len - ceil(threshold * len) + 1 of their tokens in any fixed order, so
    only items that meet on such a token are compared; rare tokens come first. Equal texts are compared once."""
    places: dict[str, list[int]] = {}
    sets: dict[str, set[str]] = {}
    for pos, text, words in items:
        places.setdefault(text, []).append(pos)
        if text not in sets:
            sets[text] = set(words)
    if len(sets) < 2:
        return
    often = Counter(w for s in sets.values() for w in s)
    met: dict[str | None, list[str]] = {}
    for text, own in sets.items():
        # A set can only be as similar as that to one of not many fewer or more tokens; empty sets are equal and meet on None.
        n = len(own)
        first = sorted(own, key=lambda w: (often[w], w))[: n - math.ceil(n * threshold - 1e-9) + 1] if n else [None]
        for other in dict.fromkeys(x for w in first for x in met.get(w, ())):
            theirs = sets[other]
            m = len(theirs)
            if min(n, m) < threshold * max(n, m) - 1e-9:
                continue
            common = len(own & theirs)
            jaccard = common / (n + m - common) if n or m else 1.0
            if jaccard >= threshold:
                yield from ((min(p, q), max(p, q), jaccard) for p in places[other] for q in places[text] if p != q)
        for w in first:
            if w is None or often[w] > 1:
                met.setdefault(w, []).append(text)


def near_duplicates(items: DataFrame, unit: str, text: str, pos: str, tokens: Column, threshold: float = 0.85, first: int = 1000) -> DataFrame:
    """Pairs (left_pos < right_pos) of a unit's items with different texts and a token Jaccard of at least threshold, among
    its first items (the limit is part of the measure).

    The items are moved once, to the unit that they belong to, and tokens are made there: a task reads its units one after
    another, holds the first items of one, and gives its pairs away in batches."""
    ship(items.sparkSession)
    own = items.where(F.col(unit).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(unit).orderBy(pos))).where(F.col("_r") <= first)
    own = own.select(F.col(unit).alias("_u"), F.col(pos).alias("_p"), F.col(text).alias("_x"), tokens.alias("_t"))
    own = own.where("_x IS NOT NULL AND _t IS NOT NULL").sortWithinPartitions("_u", "_p")
    kinds = {unit: items.schema[unit].dataType, "left_pos": items.schema[pos].dataType, "right_pos": items.schema[pos].dataType, "jaccard": DoubleType()}
    types = {name: to_arrow_type(kind) for name, kind in kinds.items()}

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, list[tuple]]]:
        now, held = None, []
        for b in batches:
            for k in range(0, b.num_rows, 256):
                for u, *item in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True):
                    if held and u != now:
                        yield now, held
                        held = []
                    now = u
                    held.append(item)
        if held:
            yield now, held

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((u, *pair) for u, held in units(batches) for pair in similar_sets(held, threshold))
        while some := list(itertools.islice(rows, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types.values(), strict=True)], names=list(types))

    return own.mapInArrow(pairs, StructType([StructField(name, kind) for name, kind in kinds.items()]))


def located(points: DataFrame, spans: DataFrame, unit: str, at: str, start: str, end: str, case: str) -> DataFrame:
    """The span of its unit that each point lies in; null where none holds it. Spans of a unit don't overlap.

    One sorted pass instead of a range join: the last span that starts at or before a point is the only one that can hold it."""
    p = points.withColumn("_point", F.lit(1)).withColumn("_at", F.col(at)).withColumn("_end", F.lit(None).cast("long")).withColumn("_case", F.lit(None).cast(spans.schema[case].dataType))
    s = spans.select(unit, F.lit(0).alias("_point"), F.col(start).alias("_at"), F.col(end).cast("long").alias("_end"), F.col(case).alias("_case"))
    run = W.partitionBy(unit).orderBy("_at", "_point").rowsBetween(W.unboundedPreceding, 0)
    both = p.unionByName(s, allowMissingColumns=True)
    last = F.last(F.when(F.col("_point") == 0, F.struct("_end", "_case")), ignorenulls=True).over(run)
    out = both.withColumn("_s", last).where("_point = 1")
    return out.select(*points.columns, F.when(F.col(at) <= F.col("_s._end"), F.col("_s._case")).alias(case))


def batch_results(cases: DataFrame, diagnostics: DataFrame, batch: str, case: str) -> DataFrame:
    """Verdicts of cases that were run in batches: a case fails if a diagnostic lies in its lines, and passes if none does,
    but a diagnostic that no case holds leaves every case of its batch open."""
    found = located(diagnostics, cases, batch, "line", "start", "end", case)
    bad = found.groupBy(batch).agg(F.bool_or(F.col(case).isNull()).alias("_lost"))
    hit = found.where(F.col(case).isNotNull()).select(batch, case).distinct().withColumn("_hit", F.lit(True))
    out = cases.join(bad, batch, "left").join(hit, [batch, case], "left")
    return out.withColumn("success", F.when(F.coalesce("_lost", F.lit(False)), None).otherwise(F.col("_hit").isNull())).drop("_lost", "_hit")
