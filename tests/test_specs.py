from __future__ import annotations

import random

import pytest

from trivane.functions import lexer, specs

SOURCE = '''
// fn hidden()
/* outer /* fn inner() */ still */
pub open spec fn sorted(s: Seq<int>) -> bool { forall|i: int, j: int| 0 <= i < j < s.len() ==> s[i] <= s[j] }
fn find(v: &Vec<u32>, k: u32) -> (r: Option<usize>)
    requires v.len() < 100, sorted(v@),
    ensures
        match r { Some(i) => v[i as int] == k, None => true },
        r.is_some() ==> k >= 0
{
    let mut i = 0;
    while i < v.len()
        invariant i <= v.len(), true
        decreases v.len() - i
    {
        assert(v@.len() >= i) by { lemma(a, b); }
        if v[i] == k { return Some(i); }
        i = i + 1;
    }
    None
}
fn main() { let s = "fn quoted() // no"; let c = 'a'; let l: &'static str = r#"raw " fn "#; }
'''


def test_comments_nest_and_literals_stay():
    out = lexer.strip_comments(SOURCE)
    assert "hidden" not in out and "inner" not in out and "still" not in out
    assert '"fn quoted() // no"' in out and 'r#"raw " fn "#' in out
    assert out.count("\n") == SOURCE.count("\n")


def test_token_spans_point_at_their_text():
    for t in lexer.scan(SOURCE):
        assert SOURCE[t.start : t.end] == t.text
    assert [t.text for t in lexer.tokens("a ==> b::<c> 'x' 'life r\"q\"")] == ["a", "==>", "b", "::", "<", "c", ">", "'x'", "'life", 'r"q"']


@pytest.mark.parametrize("text,want", [("a, f(b, c), |x, y| z", ["a", "f(b, c)", "|x, y| z"]), ("V::<u8, u16>::new(), b", ["V::<u8, u16>::new()", "b"]), ("a < b, c > d", ["a < b", "c > d"]), ("", [])])
def test_commas_outside_brackets(text, want):
    assert lexer.split_commas(text) == want


def test_matching_bracket_ignores_literals():
    text = 'f(")", (a), b)'
    assert lexer.matching(text, 1) == len(text) - 1
    assert lexer.matching("f((a)", 1) is None


def test_clauses_of_a_function():
    got = [(c.kind, c.normalized) for c in specs.clauses(SOURCE)]
    assert got == [
        ("requires", "v . len ( ) < 100"),
        ("requires", "sorted ( v @ )"),
        ("ensures", "match r { Some ( i ) => v [ i as int ] == k , None => true }"),
        ("ensures", "r . is_some ( ) ==> k >= 0"),
        ("invariant", "i <= v . len ( )"),
        ("invariant", "true"),
        ("decreases", "v . len ( ) - i"),
        ("assert", "v @ . len ( ) >= i"),
    ]


def test_functions_and_targets():
    fs = specs.functions(SOURCE)
    assert [(f.name, f.mode) for f in fs] == [("sorted", "spec"), ("find", "exec"), ("main", "exec")]
    assert fs[1].parameters == (("v", "&Vec<u32>"), ("k", "u32")) and fs[1].returns == (("r", "Option<usize>"),)
    assert specs.target(SOURCE) == "find" and specs.target("fn main() {}") is None
    assert specs.target("fn a() {} fn b() requires x {} fn c() {}") == "b"
    assert specs.contract(fs[2]) == {"requires": ["true"], "ensures": ["true"]}
    assert specs.signature_issues(fs[1], fs[2]) == ["parameter_count", "return_count"]


def test_masking_removes_one_contract():
    text, contract = specs.masked(SOURCE, "find")
    assert len(contract["requires"]) == 2 and len(contract["ensures"]) == 2
    assert "requires" not in text and "invariant" in text


@pytest.mark.parametrize(
    "text,reason",
    [("true", "literal_true"), ("((x)) == x", "self_comparison"), ("x + 0 <= x", "arithmetic_identity"), ("v.len() >= 0", "nonneg_tautology"), ("0 <= n < v.len()", None), ("true && x >= x", "compound_tautology"), ("true && x >= 1", None), ("if c then true else true", "compound_tautology"), ("if c then (a == a) else a == a", "compound_tautology"), ("if c then x > 1 else x > 1", None), ("(a && b) || !(a && b)", "excluded_middle"), ("a ==> a", "implication_self"), ("a <==> a", "equivalence_self"), ("p || !p", "excluded_middle"), ("n >= 0", "nonneg_tautology"), ("a ==> true", "low_information_implication"), ("forall|i: int| i == i", "quantifier_trivial_body"), ("x || true", "compound_tautology"), ("x < y", None), ("", None)],
)
def test_tautologies(text, reason):
    assert specs.tautology(text, frozenset({"n"})) == reason


def test_contradictions():
    assert specs.contradictions("x > 3 && x <= 3") == ["strict_empty_interval:x"]
    assert specs.contradictions("x >= 5 && x <= 3") == ["inconsistent_bounds:x"]
    assert "conflicting_equality:x" in specs.contradictions("x == 2 && x != 2")
    assert specs.contradictions("a < a") == ["self_contradiction:a < a"] and specs.contradictions("x > 1 && x < 3") == []


def test_structure_folds_chains():
    s = specs.structure("a && b && c && d")
    assert (s.nodes, s.depth) == (7, 1)
    s = specs.structure("forall|i: int| p ==> (exists|j: int| q(j))")
    assert (s.quantifiers, s.alternation, s.depth, s.ok) == (2, 1, 1, True)


def test_structure_never_fails():
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice("ab()[]{}|&=<>!,.;: \"'/*") for _ in range(30))
        specs.structure(text), specs.clauses("requires " + text), specs.functions(text), specs.mutants("fn f() {" + text)


@pytest.mark.parametrize(
    "body,want",
    [
        ("a == 2", {"ROR": 5}),
        ("a < 2", {"ROR": 3}),
        ("let v: Vec<u8> = w;", {}),
        ("a * b + 1", {"AOR": 5, "BOUNDARY": 3}),
        ("a + -1", {"AOR": 3, "BOUNDARY": 5}),
        ("if !done { x = true; }", {"UOI_UOD": 1, "BOUNDARY": 1}),
        ("while go.on() && b { }", {"UOI_UOD": 1, "COR_LOR": 1}),
        ("p + q", {"AOR": 2, "SVR": 2}),
        ("proof { a < b } assert(a < b); 5", {}),
        ("a -> b; a => c; a >= 0", {"ROR": 3, "BOUNDARY": 2}),
    ],
)
def test_mutants_by_family(body, want):
    got = {}
    for m in specs.mutants(f"fn f(p: u8, q: u8, r: u16) {{ {body} }}"):
        got[m["family"]] = got.get(m["family"], 0) + 1
    assert got == want


def test_merged_lines_have_exceptions():
    assert specs.merged_lines("pub fn f(a: u8) {\n    x;\n}", "pub fn f(b: u8) {\n    y;\n}") == "pub fn f(b: u8) {\n    x;\n    y;\n}"
    assert specs.merged_lines("  inv,", "    inv,") == "    inv,"
    assert specs.merged_lines("// old\na", "a\n// new") == "// old\na"


def test_mutants_change_one_token():
    for m in specs.mutants(SOURCE):
        assert SOURCE[m["start"] : m["end"]] == m["old"] != m["new"]
    assert len({m["id"] for m in specs.mutants(SOURCE)}) == len(specs.mutants(SOURCE))
    assert not any(m["old"] == "<=" for m in specs.mutants(SOURCE))  # clauses aren't executed


def test_splice():
    assert specs.splice("abcdef", [(4, 5, "X"), (0, 1, "")]) == "bcdXf"
    with pytest.raises(ValueError):
        specs.splice("abc", [(0, 2, ""), (1, 3, "")])


def test_small_tools():
    assert specs.fenced("x ```rust\nab\n``` ```\nabcd\n```") == "abcd\n" and specs.fenced("plain") == "plain"
    assert specs.json_slice('hey {"a": "}", "b": [1]} x') == '{"a": "}", "b": [1]}' and specs.json_slice("[1") is None
    assert specs.typed_value("[1, 2]", "Vec<u8>") == (True, [1, 2]) and specs.typed_value("300", "u8")[0] is False
    assert specs.typed_value("(1, None)", "(i32, Option<u8>)") == (True, [1, None]) and specs.typed_value("[1]", "[u8; 2]")[0] is False
    assert specs.value_tags([[], [1, 1], 0, True]) == ["bool", "boundary", "duplicate", "empty", "multi"]
    assert specs.value_variants(True) == [False] and 6 in specs.value_variants(5) and [] in specs.value_variants([1])
    assert specs.merged_lines("a\nb", "b\nc") == "a\nb\nc"
    assert specs.alpha_normalized("spec fn f(a: int) -> bool { a > 0 }") == specs.alpha_normalized("spec fn f(b: int) -> bool { b > 0 }")
    view = specs.executable_view(specs.functions(SOURCE)[1].body)
    assert "return Some(i);" in view and "invariant" not in view and "lemma" not in view
    assert ("weakening", "a <= b") in specs.weaker_stronger("a < b")
    assert specs.types("struct S { a: u32 } type T = Vec<u8>;") == {"S": "struct { a : u32 }", "T": "type = Vec < u8 >"}
    assert [k for k, _ in specs.blacklisted("assume(false); // admit()")] == ["assume_false"]


def test_long_clause_lists_take_time_in_proportion():
    import time

    def seconds(n):
        text = "fn f(x: u32) requires " + ", ".join(f"x < {k}" for k in range(n)) + " { }"
        began = time.perf_counter()
        assert len(specs.clauses(text)) == n and specs.functions(text)[0].name == "f"
        return time.perf_counter() - began

    seconds(200)
    assert min(seconds(3200) for _ in range(2)) < 40 * min(seconds(200 + k) for k in range(3))


def test_scopes_of_a_text_share_its_items(monkeypatch):
    from trivane.functions import contracts

    found, real = [], contracts.clauses
    monkeypatch.setattr(contracts, "clauses", lambda t: found.append(t) or real(t))
    text = "spec fn once() -> int { 1 } fn g() requires true { assert(1 == 1); }"
    assert [len(contracts.scoped_items(text, s)) for s in ("full", "spec_only", "proof")] == [3, 2, 1]
    assert len(found) == 1


def test_results_are_objects_for_few_rows_at_a_time():
    import pyarrow as pa

    from trivane.functions import parsing

    done = []
    out = parsing.sliced(lambda x, y: done.append(x) or x + y, pa.int64(), [(pa.array(range(1000)), pa.array([1] * 1000))])
    assert next(out).to_pylist() == list(range(1, parsing.ROWS + 1)) and len(done) == parsing.ROWS
    assert sum(len(a) for a in out) == 1000 - parsing.ROWS


def test_paths_of_deep_walks():
    import time

    from trivane.functions import walks

    def deep(n):
        check = {"holds": True, "status": "s", "lemma_harness_version": 1, "clause": "x > 1"}
        for _ in range(n):
            check = {"k": [check]}
        return check

    assert [r["path"] for r in walks.obligations(deep(2))] == ["k.0.k.0"]

    def seconds(n):
        value, began = deep(n), time.perf_counter()
        assert len(list(walks.obligations(value))) == 1
        return time.perf_counter() - began

    seconds(30)
    assert min(seconds(4000) for _ in range(3)) < 50 * min(seconds(250) for _ in range(5))


def test_items_of_a_text_come_from_one_scan(monkeypatch):
    from trivane.functions import contracts, lexer

    scanned, plain = [], lexer._scan
    for name in ("_scan", "_scanned"):
        monkeypatch.setattr(lexer, name, lambda text: scanned.append(text) or plain(text))
    text = "fn f(x: u8) requires x < 1, x > 0 { assert(x == 1) by { g() } } // c\nspec fn h() -> int { 1 } /* d\n */ proof fn k() ensures true { }"
    found = contracts._text_items.__wrapped__(text)
    assert scanned == [text]
    assert [(x["kind"], x["normalized"]) for x in found] == [
        ("requires", "x < 1"), ("requires", "x > 0"), ("assert", "x == 1"), ("assert_by", "{ g() }"), ("spec_fn", "spec fn h() -> int { 1 }"), ("proof_fn", "proof fn k() ensures true { }"),
    ]


def test_tokens_of_a_stripped_text_are_those_of_a_scan():
    import random

    from trivane.functions import contracts, lexer

    rng = random.Random(5)
    parts = ["fn f(x: u8)", "spec fn h() {", "}", "requires", "x < 1,", "assert(p) by { q }", "//c\n", "/*b*/", "/*\n*/", "/*", "'", "'a", "' '", '"s //"', 'r#"x"#', "r", "/", "*", " ", ";", "spec fn"]
    spans = lambda toks: [(t.kind, t.text, t.start, t.end) for t in toks]
    for _ in range(4000):
        text = rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        clean, toks = lexer.stripped(text)
        assert clean == lexer.strip_comments(text) and spans(toks) == spans(lexer.tokens(clean))
        cuts = sorted((f.start, f.end) for f in specs.functions(clean) if f.mode == "spec")
        rest = list(clean)
        for a, b in cuts:
            rest[a:b] = " " * (b - a)
        rest = "".join(rest)
        assert spans(contracts._outside(rest, toks, cuts)) == spans(lexer.tokens(rest))
