import pytest

from grammar_cases import BROKEN, VALID
from millrace.llm import foreign, rustparse, unparsed

GOOD = [
    "", "// only\n/* a /* nested */ comment */", "fn main() {}", "#!/usr/bin/env run\nfn a() {}", "#![allow(x)]\n//! inner\nuse a::{b, c::*, d as _};",
    "pub(crate) const fn f<'a, T: Fn(u8) -> u8 + 'a, const N: usize>(mut self: Box<Self>, x: &'a [T; N]) -> impl Iterator<Item = u8> + 'a where T: Copy, {}",
    "struct A; struct B(pub u8, (u8, u8)); struct C<T> where T: X { pub(in a::b) x: T, }", "enum E { A, B(u8), C { x: u8 } = 3, }", "union U { a: u8 }", "static mut X: [u8; 3] = [0; 3];",
    "fn f() { let x = if a { 1 } else if let Some(y) = b { 2 } else { 3 }; match x { 0..=3 | 9 => {} y @ 1.. if y > 2 => (), _ => return, } }",
    "fn f() { let v: Vec<Vec<u8>> = a::<b>::c::<Vec<Vec<u8>>>(x)?.await; x.0.1.y; a..b; ..; &a[1..]; }", "fn f() { if x == (S { a: 1 }) {} for i in 0..n { continue 'a; } 'a: loop { break 'a 3; } }",
    "fn f() { let c = |a: u8, &(b, _): &(u8, u8)| -> u8 { a }; move || x; async move { y }; unsafe { z } }", 'fn f() { r#"a " b"#; b"\\x00"; b\'\\\'\'; \'\\u{1F600}\'; c"x"; br##"#"##; 1_000u64; 0xffu8; 1e-3f32; 1.; }',
    "impl<T> const A for B<T> { type C = D; const E: u8 = 1; fn f(&mut self) {} m! {} }", "trait T: A + ?Sized { type X<'a>: B where Self: 'a; fn f(self); }", "macro_rules! m { ($x:expr) => { $x }; (@go $($y:tt)*) => {} }",
    'extern "C" { fn f(x: *const u8, ...); static S: u8; type T; }', "fn f() { println!(\"{}\", x); vec![1; 3].len(); m! { any ) }; }".replace(" any ) ", " any "), "fn f() { let Some(x) = y else { return; }; let [a, .., b] = c; }",
    "fn f() { <T as A>::b(); <[u8]>::len(x); let x: <T as A>::B; T::<u8> { a, ..b }; }", "fn f() -> ! { match x { A { b: C(..), .. } => 1, -1 => 2, 'a'..='z' => 3, \"s\" => 4, ref mut q => 5 }; loop {} }",
    "fn f() { a = b; a += 1; *p = 2; (a, b) = (b, a); _ = c; (a as u8) < b; !-*&mut x; a && b || c; }", "fn f(_: dyn Fn(&u8) + Send, g: fn(a: u8) -> u8, h: for<'a> fn(&'a u8), i: *mut [u8]) {}", "fn f() { if let A | B = x && y {} while let Some(z) = it.next() {} }",
    "fn f() { let x = match y { _ => {} }; {} ; if a {} [1]; match z {}.foo(); }", "pub type T = Result<(), Box<dyn std::error::Error>>;", "fn r#match(r#type: u8) {}", "const _: () = { assert!(1 == 1); };", "fn f() { a.b::<C>(d); x?.y()?; }", "async unsafe extern \"C\" fn f() {}",
]
BAD = [
    "fn", "fn f( {}", "fn f() { let x = ; }", "fn f() { a b }", "fn f() { if x }", "fn f() {", "}", "struct S { a u8 }", "fn (x: u8) {}", "let x = 1;", "fn f() { x = = 1; }", "<<<<<<< HEAD\nfn f() {}", "fn f() { else {} }", "enum E { A = }", "use a::{b, ;",
    "int main(void) { return 0; }", "fn f() { a as u8 < b; }", "#include <a.h>", "fn f() { let fn = 1; }", "fn f() { a < b < c; }", 'fn f() { "open }', "/* open", "fn f() { match x { 1 2 => 3 } }", "fn f() { x++; }", "```rust\nfn f() {}\n```", "def f(x):\n    pass", '{"a": 1}', "fn f(a; u8) {}",
    "fn f() { let x = a ? b : c; }", "fn f() { p->x; }", "fn f() { 'ab' }", "fn f() { 1abc; }", 'fn f() { "\\q"; }', "impl A { let x = 1; }", "fn f() { for (int i = 0; i < n; i++) {} }", "fn f() { ) }", "mod a { fn }", "Note: text is no code.", "fn f() { /// doc\n }", "fn f() { return 1 2; }", "pub pub fn f() {}",
]


@pytest.mark.parametrize("text", GOOD)
def test_accepts(text):
    assert rustparse.error_in(text) is None


@pytest.mark.parametrize("text", BAD)
def test_rejects(text):
    assert rustparse.error_in(text) is not None


def test_deep_and_long():
    assert rustparse.error_in("fn f() { " + "x = 1;\n" * 100_000 + "}") is None
    assert rustparse.error_in("fn f() { " + "(" * 50_000) is not None
    assert rustparse.error_in("fn f() { x" + " + 1" * 20_000 + "; }") is None


@pytest.mark.parametrize(
    "text,lang",
    [
        ("#include <a.h>\nstatic int f(char *p)\n{\n    return p->x ? 1 : (int)sizeof(*p);\n}\n", "c"),
        ("def f(x):\n    return [y for y in x]\n", "python"),
        ('{"rust_code": "fn f() {}"}', "json"),
        ('[package]\nname = "a"\n[dependencies]\nlibc = "0.2"\n', "toml"),
        ("export const f = async (a) => { const { b, ...c } = await g(a); return `${b}` ?? c; };\n", "javascript"),
        ("int f( { return", None),
        ("just some words", None),
    ],
)
def test_foreign(text, lang):
    assert foreign.foreign_language(text) == lang


def test_operator(spark):
    schema = "id string, source_id string, converted_code string, status string, verdict string, text string"
    rows = [("a", "s1", "fn f() {}", "failed"), ("b", "s1", "fn f( {", "success"), ("b", "s1", "fn f( {", "success"), ("c", "s2", None, None), ("d", None, " \n", None), ("e", "s3", "int x(void) { return 1; }\n", "success"), ("f", "s1", "// note", "failed")]
    conv = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    trans = spark.createDataFrame([("a", "s1", "x y z")], "id string, source_id string, rust_code string")
    got = sorted(tuple(r)[:3] for r in unparsed.unparsed_records(conv, trans).collect())
    assert got == [("conversion_results", "b", "corrupt"), ("conversion_results", "e", "foreign"), ("translation_results", "a", "corrupt")]
    entries = spark.createDataFrame([("s1", "/w/Proj/", " C"), ("s1", "other", "rs")], "id string, project string, language string")
    rates = {(r.record_table, r.project): (r.n_records, r.n_corrupt, r.n_foreign) for r in unparsed.failure_rates(conv, trans, entries.limit(1)).collect()}
    assert rates == {("conversion_results", "proj"): (2, 1, 0), ("conversion_results", "unknown"): (1, 0, 1), ("translation_results", "proj"): (1, 1, 0)}
    assert unparsed.unparsed_records(conv.limit(0), trans.limit(0)).count() == 0
    assert unparsed.failure_rates(conv.limit(0), trans.limit(0), entries).count() == 0


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in VALID.items() for t in v])
def test_foreign_accepts(lang, text):
    assert foreign.parses_as(text, lang)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BROKEN.items() for t in v])
def test_foreign_rejects(lang, text):
    assert not foreign.parses_as(text, lang)


def test_nested_as_deep_as_it_gets():
    assert rustparse.error_in("fn f() { " + "(" * 5000 + "1" + ")" * 5000 + "; }") is None
    assert rustparse.error_in("fn f() " + "{" * 8000 + "}" * 8000) is None
    assert foreign.parses_as("int f(void) { return " + "(" * 3000 + "1" + ")" * 3000 + "; }", "c")
    assert foreign.parses_as("x = " + "[" * 3000 + "]" * 3000, "javascript")


@pytest.mark.parametrize("text,good", [('fn f() { r####"a "## b"####; }', True), ('fn f() { br#####"a"#####; r"x"; }', True), ('fn f() { r####"a"###; }', False), ('// r####"\nfn f() {}', True), ('fn f() { "r####"; }', True)])
def test_raw_strings(text, good):
    assert (rustparse.error_in(text) is None) == good


def test_all_grammars_are_tried():
    assert unparsed.verdict("int f(int x) { return x; }")[2] == ["c", "cpp"]
    assert unparsed.verdict("fn f() {}")[:2] == ("ok", "rust")
    assert unparsed.verdict("{}")[0] == "foreign"


def test_one_verdict_for_an_id(spark):
    conv = spark.createDataFrame([("a", "s", "fn f() {}"), ("a", "s", "fn f( {"), ("b", "s", None), ("b", "s", "int f(void) { return 1; }")], "id string, source_id string, converted_code string")
    none = conv.limit(0).withColumnRenamed("converted_code", "rust_code")
    assert {r.record_id: r.verdict for r in unparsed.unparsed_records(conv, none).collect()} == {"a": "corrupt", "b": "foreign"}
    entries = spark.createDataFrame([], "id string, project string, language string")
    r = unparsed.failure_rates(conv, none, entries).first()
    assert (r.n_records, r.n_foreign, r.n_corrupt) == (2, 1, 1)
