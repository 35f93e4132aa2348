"""Columns from specification texts: Arrow-batched functions over whole texts, one row's failure staying in its row.

Call ready(spark) once before use, so that Python workers can import this package."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from trivane.functions import lexer, specs
from trivane.session import ship

ready = ship


#: Rows whose values and results a worker holds as objects at once.
ROWS = 64


def sliced(f: Callable, of: pa.DataType, batches: Iterable[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for columns in batches:
        for k in range(0, len(columns[0]), ROWS):
            values = (c.slice(k, ROWS).to_pylist() for c in columns)
            yield pa.array([f(*x) for x in zip(*values, strict=True)], of)


def applied(f: Callable, kind: str, *cols: str | Column) -> Column:
    """f of every row's values, of the type kind (structs as dicts, maps as lists of pairs).

    Arrow's batches hold thousands of rows whatever the length of their texts; they are gone through and sent back a few rows
    at a time, as objects take many times the room of the texts that they come from."""
    of = to_arrow_type(DataType.fromDDL(kind))

    def rows(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return sliced(f, of, batches)

    def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(f, of, ((c,) for c in batches))

    run = F.arrow_udf(single if len(cols) == 1 else rows, kind)
    return run(*[F.col(c) if isinstance(c, str) else c for c in cols])


def _udf(kind: str):
    """A function of a row's values as one of columns, made when used, as a session must exist then."""

    def wrap(f):
        @functools.wraps(f)
        def call(*cols):
            return applied(f, kind, *cols)

        return call

    return wrap


@_udf("string")
def strip_comments(text):
    return None if text is None else lexer.strip_comments(text)


@_udf("string")
def normalized(text):
    return None if text is None else lexer.normalized(text)


@_udf("array<struct<text:string,start:int,end:int>>")
def token_spans(text):
    return None if text is None else [{"text": t.text, "start": t.start, "end": t.end} for t in lexer.tokens(text)]


@_udf("array<struct<kind:string,text:string,normalized:string>>")
def clauses(text):
    return None if text is None else [{"kind": c.kind, "text": c.text, "normalized": c.normalized} for c in specs.clauses(text)]


@_udf("array<struct<name:string,mode:string,header:string,body:string,signature:string,requires:array<string>,ensures:array<string>>>")
def functions(text):
    if text is None:
        return None
    return [{"name": f.name, "mode": f.mode, "header": f.header, "body": f.body, "signature": specs.signature(f), **specs.contract(f)} for f in specs.functions(text)]


@_udf("struct<nodes:int,depth:int,quantifiers:int,alternation:int,operators:array<string>,variables:array<string>,ok:boolean>")
def structure(text):
    if text is None:
        return None
    s = specs.structure(text)
    return {"nodes": s.nodes, "depth": s.depth, "quantifiers": s.quantifiers, "alternation": s.alternation, "operators": list(s.operators), "variables": list(s.variables), "ok": s.ok}


@_udf("string")
def tautology(text):
    return None if text is None else specs.tautology(text)


@_udf("array<string>")
def contradictions(text):
    return None if text is None else specs.contradictions(text)


@_udf("array<struct<kind:string,snippet:string>>")
def blacklisted(text):
    return None if text is None else [{"kind": k, "snippet": s} for k, s in specs.blacklisted(text)]


@_udf("array<struct<id:string,function:string,family:string,start:int,end:int,old:string,new:string>>")
def mutants(text):
    return None if text is None else specs.mutants(text)


@_udf("string")
def target(text, catalog, marker):
    return None if text is None else specs.target(text, catalog, marker)


@_udf("string")
def executable_view(text):
    return None if text is None else specs.executable_view(text)


@_udf("string")
def alpha_normalized(text):
    return None if text is None else specs.alpha_normalized(text)


@_udf("string")
def json_slice(text):
    return None if text is None else specs.json_slice(text)


@_udf("string")
def merged_lines(a, b):
    return None if a is None or b is None else specs.merged_lines(a, b)


@_udf("int")
def lcs_length(a, b):
    """Length of the longest common subsequence of two token arrays, a machine word of tokens at a time (Hyyrö 2004)."""
    if a is None or b is None:
        return None
    a, b = list(a), list(b)
    where: dict = {}
    for k, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        m = where.get(t, 0)
        u = v & m
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def fenced(text: Column) -> Column:
    """The longest fenced block, the first of equals; the whole text if there is none."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```"), F.lit(1))
    best = F.aggregate(blocks, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(F.size(blocks) > 0, best).otherwise(text)


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


@_udf("boolean")
def decided(condition, env_json):
    """Whether a condition holds for the values of a JSON object; null where that isn't known."""
    import json

    from trivane.functions import contracts

    return None if condition is None or env_json is None else contracts.decide(condition, json.loads(env_json))


@_udf("array<struct<operator:string,kind:string,old:string,new:string,text:string,rank:int>>")
def variants(text, name, seed):
    from trivane.functions import contracts

    return None if text is None else contracts.variants(text, name, seed)


@_udf("array<struct<kind:string,normalized:string,start:int>>")
def text_items(text, scope):
    from trivane.functions import contracts

    return None if text is None else contracts.scoped_items(text, scope)


@_udf("array<string>")
def callees(body):
    from trivane.functions import contracts

    return None if body is None else contracts.callees(body)


@_udf("array<string>")
def binding_issues(reference, generated, name):
    """Issues of binding the function of this name in a generated text to that in its reference; empty if there is none."""
    from trivane.functions import contracts

    pick = lambda t: next((f for f in specs.functions(t or "") if f.name == name), None)
    return contracts.binding_issues(pick(reference), pick(generated))


@_udf("string")
def canonical_key(json_text):
    """The short key of a JSON value, whatever the order of its keys and its blanks."""
    import json

    from trivane.functions import contracts

    return None if json_text is None else contracts.case_key(json.loads(json_text))


@_udf("array<string>")
def candidate_inputs(json_text, most):
    """Seed inputs and those one edge away, as canonical JSON."""
    import json

    from trivane.functions import contracts

    return None if json_text is None else [contracts.canonical_json(c) for c in contracts.candidate_cases(json.loads(json_text), most=most)]


def judge_gate(generated_ok: Column, reference_ok: Column, generated_hash: Column, reference_hash: Column, judged: Column) -> Column:
    """struct(status, score): 0 where the generated side fails the front end, nothing where the reference does, 1 for equal
    texts, else the judge's stored score, which may be missing."""
    row = lambda s, v: F.struct(F.lit(s).alias("status"), (v if isinstance(v, Column) else F.lit(v).cast("double")).alias("score"))
    return (
        F.when(~F.coalesce(generated_ok, F.lit(False)), row("ok", 0.0))
        .when(~F.coalesce(reference_ok, F.lit(False)), row("not_available", None))
        .when(generated_hash == reference_hash, row("ok", 1.0))
        .when(judged.isNotNull(), row("ok", judged.cast("double")))
        .otherwise(row("pending", None))
    )


def trivial_implication(consequent: Column) -> Column:
    """struct(holds, reason) of an implication that is settled without a prover: nothing or only true is to be shown."""
    rest = F.filter(consequent, lambda x: x.isNotNull() & (F.trim(x) != ""))
    out = lambda why: F.struct(F.lit(True).alias("holds"), F.lit(why).alias("reason"))
    return F.when(F.size(rest) == 0, out("empty_consequent")).when(F.forall(rest, lambda x: x == "true"), out("true_consequent"))
