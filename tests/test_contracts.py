from __future__ import annotations

import itertools

import pytest

from trivane.functions import contracts, specs

ENV = {"x": 3, "v": [1, 2, 5], "r": None}
SOURCE = "fn f(x: u32, v: u8) -> (r: u32)\n requires x < 5, v > 0,\n ensures r == x\n{ g(x); a::b(c); x }"


@pytest.mark.parametrize(
    "text,want",
    [
        ("x < 4 && v.len() == 3", True),
        ("forall|i: int| 0 <= i < v.len() ==> v[i] > 0", True),
        ("forall|i: nat| i >= 0", True),
        ("forall|i: int| i >= 0", False),
        ("exists|i: int, j: int| i + j == 2 * x && i > j", True),
        ("y > 0", None),
        ("x > 5 ==> y > 0", True),
        ("y > 0 ==> x == 3", True),
        ("y > 0 ==> x == 4", None),
        ("false && y > 0", False),
        ("true || y > 0", True),
        ("v@[1] as int == 2", True),
        ("v[9] == 1", None),
        ("!(x == 3)", False),
        ("v.contains(5) && !v.contains(4)", True),
        ("(x + 1) * 2 - 1 == 7", True),
        ("0 <= x <= 2", False),
        ("__import__(1)", None),
        ("", True),
    ],
)
def test_decisions(text, want):
    assert contracts.decide(text, ENV) is want


def test_three_valued_connectives():
    names = {"t": True, "f": False}
    value = {"t": True, "f": False, "u": None}
    for a, b in itertools.product("tfu", repeat=2):
        p, q = value[a], value[b]
        both = False if False in (p, q) else None if None in (p, q) else True
        either = True if True in (p, q) else None if None in (p, q) else False
        implies = True if p is False or q is True else None if None in (p, q) else q
        assert contracts.decide(f"{a} && {b}", names) is both and contracts.decide(f"{a} || {b}", names) is either and contracts.decide(f"{a} ==> {b}", names) is implies


def test_edits_keep_the_rest():
    added = contracts.insert_clause(SOURCE, "f", "requires", "x > 1,")
    assert [c.normalized for c in specs.clauses(added) if c.kind == "requires"] == ["x > 1", "x < 5", "v > 0"]
    for k in (0, 1):
        left = [c.normalized for c in specs.clauses(contracts.remove_clause(SOURCE, "f", "requires", k)) if c.kind == "requires"]
        assert left == [["v > 0"], ["x < 5"]][k]
    gone = contracts.remove_clause(SOURCE, "f", "ensures", 0)
    assert not any(c.kind == "ensures" for c in specs.clauses(gone)) and specs.functions(gone)[0].body == specs.functions(SOURCE)[0].body
    new = contracts.insert_clause("fn h() { }", "h", "ensures", "true")
    assert [c.kind for c in specs.clauses(new)] == ["ensures"]


def test_variants_are_few_distinct_and_stable():
    got = contracts.variants(SOURCE, "f", "s", ("x != 2", "x < 5"))
    assert got == contracts.variants(SOURCE, "f", "s", ("x != 2", "x < 5"))
    assert {v["operator"] for v in got} >= {"PRE_ADD", "PRE_REMOVE", "PRE_RELAX", "POST_RELAX"}
    for op in contracts.OPERATORS:
        own = [v for v in got if v["operator"] == op]
        assert len(own) <= 3 and len({v["text"] for v in own}) == len(own) and [v["rank"] for v in own] == list(range(1, len(own) + 1))
    assert not any(v["operator"] == "PRE_ADD" and v["new"] == "x < 5" for v in got)


def test_items_by_scope():
    text = "spec fn s(x: int) -> bool { x > 0 }\n" + SOURCE.replace("{ g(x);", "{ assert(x > 0) by { lemma(); } g(x);")
    kinds = lambda scope: [i["kind"] for i in contracts.scoped_items(text, scope)]
    assert kinds("full") == ["spec_fn", "requires", "requires", "ensures", "assert", "assert_by"]
    assert kinds("spec_only") == ["spec_fn", "requires", "requires", "ensures"] and kinds("proof") == ["assert", "assert_by"]


def test_keys_and_candidates():
    assert contracts.case_key({"b": 1, "a": [1]}) == contracts.case_key({"a": [1], "b": 1}) != contracts.case_key({"a": [1], "b": 2})
    assert contracts.canonical_json({"b": 1, "a": 2}, compact=False) == '{"a": 2, "b": 1}'
    got = contracts.candidate_cases([{"a": 1, "v": [1, 2]}], (9,), most=7)
    assert got[0] == {"a": 1, "v": [1, 2]} and len(got) == 7 and len({contracts.case_key(c) for c in got}) == 7
    assert contracts.callees("{ g(x); a::b(c); x.h(1); if (y) {} }") == ["a::b", "g"]
    assert contracts.binding_issues(None, None) == ["missing_reference"]
