"""A searchable library of named records: keyword index, scored full-text search, structured search, call context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.session import dealt, stored

# Words that a query is searched without, and the words that make keywords.
STOP_WORDS = ("a", "an", "the", "is", "are", "be", "of", "in", "to", "for", "and", "or")
STRUCTURES = ("Seq", "Set", "Map", "Vec", "Multiset", "Array")
OPERATIONS = ("take", "push", "insert", "remove", "contains", "len", "subrange", "union", "intersect", "difference", "filter", "map", "fold", "finite", "empty")
CONCEPTS = ("forall", "exists", "trigger", "decreases", "invariant")


def keywords(text: Column, structures=STRUCTURES, operations=OPERATIONS, concepts=CONCEPTS) -> Column:
    """Structures and concepts that a text contains, and operations that it has as a word; sorted."""
    hits = [F.when(text.contains(w), F.lit(w)) for w in (*structures, *concepts)]
    hits += [F.when(text.rlike(rf"\b{w}\b"), F.lit(w)) for w in operations]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def index(library: DataFrame, name: str, terms: str) -> DataFrame:
    """Inverted index as rows (term, name), each once: a frequent term is many rows and never one list."""
    return library.select(F.explode(terms).alias("term"), name).distinct()


def postings(index: DataFrame, term: str, name: str) -> DataFrame:
    """Per term how many names it has, and the first and the last of them."""
    return index.groupBy(term).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))


def query_terms(text: str) -> list[str]:
    return [t for t in text.lower().split() if t not in STOP_WORDS]


def full_text(library: DataFrame, query: str, name: str, searchable: Column, doc: Column) -> DataFrame:
    """Records that contain a query term, with their score: share of terms, times 1.5 for each term in the name, times 1.2
    if the documentation has one. Terms match as parts of words."""
    terms = query_terms(query)
    if not terms:
        return library.where(F.lit(False)).withColumns({"matched": F.lit(0).cast("long"), "score": F.lit(0.0)})
    low = F.lower(searchable)
    count = lambda where: reduce(lambda a, b: a + b, [F.when(low.contains(t) & where(t), 1).otherwise(0) for t in terms])
    hits = count(lambda t: F.lit(True))
    in_name = count(lambda t: F.lower(F.col(name)).contains(t))
    in_doc = count(lambda t: F.coalesce(F.lower(doc), F.lit("")).contains(t))
    score = hits / len(terms) * F.pow(F.lit(1.5), in_name) * F.when(in_doc > 0, 1.2).otherwise(1.0)
    return library.withColumns({"matched": hits.cast("long"), "score": score}).where(F.col("matched") > 0)


#: Characters of a posting.
GRAM = 3


def grams(text: Column) -> Column:
    """The character sequences of GRAM of a text in lower case, each once; blanks after its end let every character begin one."""
    low = F.concat(F.lower(text), F.lit(" " * (GRAM - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - GRAM + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(GRAM))))


def gram_postings(library: DataFrame, name: str, searchable: Column) -> DataFrame:
    """(gram, name), each once: which records hold a gram. Written in the order of grams, a search reads few of its row groups.

    A record is many times its bytes in grams, so the library is dealt out before: a task makes and tells apart those of its share."""
    each = dealt(library.select(name, searchable.alias("_s"))).select(name, F.explode(grams(F.col("_s"))).alias("gram"))
    return each.select("gram", name).distinct().repartitionByRange("gram", name).sortWithinPartitions("gram", name)


def candidates(postings: DataFrame, query: str, name: str) -> DataFrame:
    """(name, bound): records that may hold terms of a query, and of how many of them; the others hold none.

    A record that holds a term has all its grams, or, for a shorter term, a gram that begins with it."""
    terms = query_terms(query)
    wanted = {t: {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for t in terms}
    long = sorted(set().union(*wanted.values())) if terms else []
    short = [t for t in terms if not wanted[t]]
    cond = reduce(lambda a, b: a | b, [F.col("gram").startswith(t) for t in short], F.col("gram").isin(long) if long else F.lit(False))
    has = lambda t: F.bool_or(F.col("gram").startswith(t)) if not wanted[t] else F.count_if(F.col("gram").isin(*wanted[t])) == len(wanted[t])
    held = postings.where(cond).groupBy(name).agg(*[has(t).cast("long").alias(f"_t{i}") for i, t in enumerate(terms)]) if terms else postings.select(name).where("false")
    return held.select(name, reduce(lambda a, b: a + b, [F.col(f"_t{i}") for i in range(len(terms))], F.lit(0).cast("long")).alias("bound")).where("bound > 0")


def bound_of(matched: int, terms: int) -> float:
    """The highest score of a record that holds so many of the terms."""
    return matched / terms * 1.5**matched * 1.2


def full_text_indexed(library: DataFrame, postings: DataFrame, query: str, name: str, searchable: Column, doc: Column, top: int | None = None) -> DataFrame:
    """As full_text(), over the records that the postings leave; with top only the best ones (ties by name).

    Of top, records are scored by the number of terms they may hold, the most first, until no record that is left can
    reach the last of the best."""
    held = candidates(postings, query, name)
    n = len(query_terms(query))
    score = lambda df: full_text(df, query, name, searchable, doc)
    if top is None or not n:
        return score(library.join(held.select(name), name, "left_semi").select(*library.columns))
    held = stored(held, "candidates")
    best = None
    for k in range(n, 0, -1):
        part = score(library.join(held.where(F.col("bound") == k).select(name), name, "left_semi").select(*library.columns))
        both = part if best is None else best.unionByName(part)
        best = stored(both.orderBy(F.desc("score"), name).limit(top), "best")
        last = best.agg(F.count(F.lit(1)), F.min("score")).first()
        if last[0] == top and last[1] > bound_of(k - 1, n):
            break
    return best


def structured(library: DataFrame, kind: Column, operations: Column, wanted_kind: str | None, wanted: list[str]) -> DataFrame:
    """Records of a data structure or with one of the operations, score 1."""
    cond = F.lit(False) if wanted_kind is None else kind == wanted_kind
    if wanted:
        cond = cond | F.arrays_overlap(operations, F.array(*[F.lit(w) for w in wanted]))
    return library.where(cond).withColumn("score", F.lit(1.0))


def ranked(results: list[DataFrame], name: str, boosts: list[tuple[Column, float]], keep: Column | None, top: int, pos: str) -> DataFrame:
    """The best score of each name over several searches, boosted where conditions hold, then filtered and cut."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    best = both.groupBy(name).agg(F.max_by(F.struct(*[c for c in both.columns if c not in (name, "score")]), "score").alias("_r"), F.max("score").alias("score")).select(name, "score", "_r.*")
    for cond, factor in boosts:
        best = best.withColumn("score", F.when(cond, F.col("score") * factor).otherwise(F.col("score")))
    if keep is not None:
        best = best.where(keep)
    return best.orderBy(F.desc("score"), pos).limit(top)


# Kinds of records that give context, those that come first and the others.
PROOFS = ("proof", "broadcast_proof", "axiom", "broadcast_axiom")
SPECS = ("closed_spec", "open_spec", "uninterp_spec")


def callees_of(results: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Names one call away from the results that are no results themselves."""
    hop = edges.join(results.select(F.col(name).alias("caller")), "caller", "left_semi").select(F.col("callee").alias(name)).distinct()
    return hop.join(results.select(name), name, "left_anti")


def context(results: DataFrame, edges: DataFrame, library: DataFrame, name: str, kind: str, pos: str, sep: str = "::") -> DataFrame:
    """(name, kind, callee, place): records that the results call, in the order of use: proofs and axioms, then specs, each by callee.

    A callee means the record of that name, else the first record (by pos) that gives context, is no result and has the callee as the end of its name. A
    record with the name of a result, whole or after the last separator, is left out, and so are records of other kinds."""
    short = lambda c: F.element_at(F.split(c, sep), -1)
    called = edges.join(results.select(F.col(name).alias("caller")), "caller", "left_semi").select("callee").distinct()
    known = library.select(F.col(name).alias("_name"), F.col(kind).alias("_kind"), F.col(pos).alias("_pos"))
    fits = F.col("_kind").isin(*PROOFS, *SPECS)
    mine = results.select(short(F.col(name)).alias("_own")).distinct()
    # Names that agree as a whole, or end in one another, agree in the last segment.
    usable = known.where(fits).join(mine, short(F.col("_name")) == F.col("_own"), "left_anti")
    exact = called.join(known.groupBy("_name").agg(F.min("_pos").alias("_pos")), F.col("callee") == F.col("_name")).select("callee", "_pos")
    tails = usable.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_name", sep))), lambda i: F.array_join(F.slice(F.split("_name", sep), -i, i), sep))).alias("callee"), "_pos", "_name")
    loose = called.join(exact.select("callee"), "callee", "left_anti").join(tails, "callee").groupBy("callee").agg(F.min("_pos").alias("_pos"))
    found = exact.unionByName(loose).join(usable, "_pos")
    one = found.groupBy("_name", "_kind").agg(F.min("callee").alias("callee"))
    first = F.when(F.col("_kind").isin(*PROOFS), 0).otherwise(1)
    return one.select(F.col("_name").alias(name), F.col("_kind").alias(kind), "callee", F.row_number().over(W.orderBy(first, "callee")).cast("long").alias("place"))


def callers(edges: DataFrame) -> DataFrame:
    """The reverse of a call graph as rows (callee, caller), each once."""
    return edges.select("callee", "caller").distinct()
