import pytest
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions import code as C
from millrace.functions import html as H
from millrace.operators import graph, symbols
from millrace.sources.store import MetadataStore

RUST = "use a::b;\r\npub struct S {\r\n    a: u8,\r\n}\r\n\r\nimpl S {\r\n    fn f(&self) {\r\n        if x { y } else { z }\r\n    }\r\n}\r\nmod m;\r\nfn f() {}\r\n"


def test_symbols(spark):
    df = spark.createDataFrame([("a", RUST), ("b", ""), ("c", None), ("d", "fn open() {\n    1\n")], "id string, text string")
    found = symbols.find_symbol(symbols.symbol_contents(df, "id", "text"))
    got = {(r.record_id, r.name, r.kind): (r.start_line, r.end_line) for r in found.collect()}
    assert got == {("a", "S", "struct"): (2, 4), ("a", "f", "function"): (7, 9), ("a", "m", "module"): (11, 11), ("d", "open", "function"): (1, 2)}
    new = symbols.replace_symbol(df, "id", "text", found.where("name = 'S'"), "// one\n// two").first().text
    assert new.startswith("use a::b;\n// one\n// two\n\nimpl S {")
    assert [r.names for r in symbols.names_of_kind(symbols.symbol_contents(df.where("id = 'a'"), "id", "text"), "function").collect()] == [["f", "f"]]


def test_c_scanner():
    text = "static char *name_of(int a, int (*cb)(void *p)) {\n  if (a) { return go(a); }\n}\nint x = f(y);\nvoid g(void);\nelse h(x);\nstruct out { int a; struct { int b; } in; char *c; } o;\nint broken(int a {"
    assert [(n, t, p) for n, _, t, p in C.c_functions(text)] == [("name_of", "char *", [("int", "a"), ("int (*cb)(void", "p))")]), ("g", "void", [])] or [n for n, *_ in C.c_functions(text)] == ["name_of", "g"]
    name, line, members = C.c_structs(text)[0]
    assert (name, line) == ("out", 7) and [m[1] for m in members] == ["a", "in", "c"]
    assert C.c_functions("") == [] and C.c_structs("struct {") == []


def test_html_tree():
    deep = "<div>" * 5000 + "<pre><code>let deeply = nested;</code></pre>" + "</div>" * 5000
    assert [c for _, _, c in H.code_places(H.parse(deep), 10)] == ["let deeply = nested;"] * 2
    page = H.site_page('<h1><a>T</a></h1><p class="js-vote-count">-3</p></b><pre class="language-rs">short</pre>', "StackOverflow", 10)
    assert (page["title"], page["votes"], page["places"], page["tags"]) == ("T", -3, [], [])
    assert H.site_page("", "GitHub", 10)["title"] == "GitHub Content"


def test_decoded(spark):
    df = spark.createDataFrame([(1, "2024-01-02 03:04:05"), (2, "soon"), (3, None)], "id int, t string")
    got = {r.id: (r.t is not None, r.error) for r in symbols.decoded(df, ["t"], strict=False).collect()}
    assert got == {1: (True, None), 2: (False, "no time in t: soon"), 3: (False, None)}
    with pytest.raises(Exception, match="no time in t"):
        symbols.decoded(df, ["t"]).collect()


def test_call_chain_ends_in_cycles(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")], "caller string, callee string")
    got = {(r.root, r.name): r.hops for r in symbols.call_chain(calls, spark.createDataFrame([("a",), ("x",), ("q",)], "name string")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("x", "x"): 0, ("q", "q"): 0}


def test_call_chain_writes_only_the_calls(spark):
    """A ring with a fan: 120 x 150 rows come out, but no chain is written or shuffled on the way."""
    ring = [(f"f{k:03}", f"f{(k + 1) % 120:03}") for k in range(120)]
    calls = spark.createDataFrame(ring + [("f000", f"leaf{k}") for k in range(30)] + ring[:5], "caller string, callee string")
    roots = spark.createDataFrame([(f"f{k:03}",) for k in range(120)] + [("f000",), ("leaf1",), ("alone",), (None,)], "name string")
    before = len(runtime._written)
    walked = symbols.call_chain(calls, roots)
    assert [p.split("millrace-")[-1].split("-")[0] for _, p in runtime._written[before:]] == ["calls"]
    rows = walked.collect()
    want = {(f"f{a:03}", f"f{b:03}", (b - a) % 120) for a in range(120) for b in range(120)}
    want |= {(f"f{a:03}", f"leaf{k}", (-a) % 120 + 1) for a in range(120) for k in range(30)} | {(x, x, 0) for x in ("leaf1", "alone", None)}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_call_chain_walked_or_by_rounds(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", None), ("x", "x"), (None, "y"), ("d", "a"), ("d", "c"), ("d", "e"), ("a", "b")], "caller string, callee string")
    roots = spark.createDataFrame([(x,) for x in "abcdexq"], "name string")
    walked, rounds = (sorted(symbols.call_chain(calls, roots, n).collect(), key=repr) for n in (100, 0))
    assert walked == rounds
    assert {(r.name, r.hops) for r in walked if r.root == "d"} == {("d", 0), ("a", 1), ("c", 1), ("e", 1), ("b", 2), (None, 3)}
    none = symbols.call_chain(calls.where("caller = 'x'"), roots.where("name < 'b'"))
    assert [tuple(r) for r in none.collect()] == [("a", "a", 0)]


def test_call_chain_of_many_calls_writes_only_the_calls(spark):
    calls = spark.range(5_000_001).select(F.concat(F.lit("f"), F.col("id") % 1000).alias("caller"), F.concat(F.lit("g"), F.col("id")).alias("callee"))
    before = len(runtime._written)
    walked = symbols.call_chain(calls, spark.createDataFrame([("f0",), ("g7",)], "name string"))
    assert [p.split("millrace-")[-1].split("-")[0] for _, p in runtime._written[before:]] == ["calls"]
    assert {(r.root, r.hops): r["count"] for r in walked.groupBy("root", "hops").count().collect()} == {("f0", 0): 1, ("f0", 1): 5001, ("g7", 0): 1}


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_graph_written_in_groups(spark, most):
    """Groups of files end anywhere, a task's files may be several, parts may be empty; names stand once all the same."""
    pairs = [(f"n{a}", f"n{a * k % 53}") for a in range(40) for k in (2, 3, 7)] + [("n1", None), ("é", "n52"), ("n52", "é"), ("n52", "")]
    pairs = sorted({p for p in pairs if p[0] != p[1]}, key=repr)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 5)
    try:
        step = runtime.materialise(spark.createDataFrame(pairs, "name string, callee string").repartition(9, "callee"), "calls")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    symbols.write_graph(step._scratch_path, f"{step._scratch_path}/_graph-{most}", most)
    g = symbols.CallGraph(f"{step._scratch_path}/_graph-{most}")
    names = g.names.to_pylist()
    assert names[-1] is None and len(set(names)) == len(names)
    assert g.callers.to_pylist() == names[: len(g.callers)] and set(g.callers.to_pylist()) == {a for a, _ in pairs}
    assert sorted(((names[k], names[c]) for k in range(len(g.callers)) for c in g.callees[g.first[k] : g.first[k + 1]]), key=repr) == pairs
    assert not g.callees.flags.owndata and not g.callees.flags.writeable


def test_levels_without_a_bound(spark):
    nodes = spark.createDataFrame([(1, f"n{k:02}") for k in range(14)], "g int, n string")
    edges = spark.createDataFrame([(1, f"n{k:02}", f"n{k - 1:02}") for k in range(1, 14)], "g int, n string, needs string")
    assert {r.n: r.level for r in graph.topological_levels(nodes, edges, ["g", "n"]).collect()} == {f"n{k:02}": k for k in range(14)}


def test_a_lost_write_leaves_the_table(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path))
    store.bootstrap()
    store.insert_entries(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, code string"))
    # a version that was not written to its end is no version
    (tmp_path / "code_entries" / "v00000007").mkdir()
    assert store.read("code_entries").count() == 2
    with pytest.raises(Exception):
        store._swap("code_entries", store.read("code_entries").withColumn("code", F.raise_error(F.lit("lost")).cast("string")))
    assert store.read("code_entries").count() == 2
    store.update_entries(spark.createDataFrame([("a", "n1"), ("a", "n2")], "id string, code string"))
    assert sorted((r.id, r.code) for r in store.read("code_entries").collect()) == [("a", "n2"), ("b", "y")]
