"""Similarity of text pairs: BLEU and feature recall as joins of counted n-grams, ROUGE-L over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions import parsing as P
from trivane.functions.states import f1, ratio


def ngrams(tokens: Column, n: Column) -> Column:
    """All n-grams of an array, joined by blanks."""
    last = F.size(tokens) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def bleu(pairs: DataFrame, key: str, candidate: str, reference: str, orders: int = 4) -> DataFrame:
    """Per pair of token arrays the score, brevity penalty and lengths.

    Exponential smoothing: the k-th order without a match counts as 1 / 2^k of a match; orders beyond the candidate's
    length are left out; no match at all is 0. Two empty texts score 1, one empty text 0."""
    sides = pairs.select(key, F.explode(F.array(F.struct(F.lit(True).alias("c"), F.col(candidate).alias("t")), F.struct(F.lit(False).alias("c"), F.col(reference).alias("t")))).alias("s"))
    grams = sides.select(key, "s.*").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(orders)))).select(key, "c", "n", F.explode(ngrams(F.col("t"), F.col("n"))).alias("g"))
    counts = grams.groupBy(key, "n", "g").agg(F.count(F.when(F.col("c"), 1)).alias("x"), F.count(F.when(~F.col("c"), 1)).alias("y"))
    per = counts.groupBy(key).agg(*[F.sum(F.when(F.col("n") == n, F.least("x", "y"))).alias(f"m{n}") for n in range(1, orders + 1)])
    out = pairs.select(key, F.size(candidate).alias("c"), F.size(reference).alias("r")).join(per, key, "left")
    # In order n the misses up to and with it decide the smoothing.
    match = [F.coalesce(F.col(f"m{n}"), F.lit(0)) for n in range(1, orders + 1)]
    total = [F.greatest(F.col("c") - n + 1, F.lit(0)) for n in range(1, orders + 1)]
    logs, misses = F.lit(0.0), F.lit(0)
    for m, t in zip(match, total, strict=True):
        misses = misses + F.when((t > 0) & (m == 0), 1).otherwise(0)
        p = F.when(m == 0, 1.0 / (F.pow(F.lit(2.0), misses) * t)).otherwise(m / t)
        logs = logs + F.when(t > 0, F.log(p)).otherwise(0.0)
    used = F.least(F.col("c"), F.lit(orders))
    bp = F.when(F.col("c") < F.col("r"), F.exp(1 - F.col("r") / F.col("c"))).otherwise(1.0)
    score = F.when((F.col("c") == 0) & (F.col("r") == 0), 1.0).when((F.col("c") == 0) | (F.col("r") == 0) | (match[0] == 0), 0.0).otherwise(F.least(F.lit(1.0), bp * F.exp(logs / used)))
    empty = (F.col("c") == 0) | (F.col("r") == 0)
    return out.select(key, "c", "r", score.alias("bleu"), F.when(empty, F.when((F.col("c") == 0) & (F.col("r") == 0), 1.0).otherwise(0.0)).otherwise(bp).alias("brevity"))


def rouge_l(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """F1 of the longest common subsequence's precision and recall; two empty texts score 1."""
    P.ready(pairs.sparkSession)
    x = pairs.select(key, F.size(candidate).alias("c"), F.size(reference).alias("r"), P.lcs_length(candidate, reference).alias("lcs"))
    both = (F.col("c") == 0) & (F.col("r") == 0)
    return x.withColumn("rouge", F.when(both, 1.0).otherwise(F.coalesce(f1(ratio("lcs", "c"), ratio("lcs", "r")), F.lit(0.0))))


# Tokens that count as features of a specification, those that never do, and words without meaning.
KEY_TOKENS = ("forall", "exists", "old", "len", "contains", "index", "Some", "None", "Ok", "Err", "result", "&&", "||", "==>", "==", "!=", "<", "<=", ">", ">=")
IGNORED_TOKENS = (",", ";", ":", "::", "(", ")", "[", "]", "{", "}", "|", ".")


def features(items: DataFrame, unit: str, side: str, kind: str, normalized: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Rows (unit, side, feature) of clause items: their kind, their key tokens and their identifiers."""
    toks = F.filter(F.split(normalized, " "), lambda t: (t != "") & ~t.isin(*IGNORED_TOKENS))
    name = lambda t: F.when(t.isin(*KEY_TOKENS), F.concat(F.lit("token:"), t)).when(t.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~t.isin(*stopwords, ""), F.concat(F.lit("identifier:"), t))
    all_ = F.concat(F.array(F.concat(F.lit("kind:"), F.col(kind))), F.array_compact(F.transform(toks, name)))
    return items.select(unit, side, F.explode(all_).alias("feature"))
