"""Operators that have no SQL equivalent, on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.operators import chunking, diagnosis, graph, lines, paths, vectors, web
from millrace.sources import fetch, files
from millrace.sources.store import MetadataStore

C_TEXT = "#include <stdio.h>\nstruct Node {\n    int value;\n    char *name;\n};\n\nstatic int add(int a, int (*f)(int, int))\n{\n    return a;\n}\nint main(void) {\n    return add(1, 0);\n}\n"
RUST_TEXT = "pub struct A {\n    x: u32,\n}\n\npub async fn go(a: &str, b: u8) -> Option<u8> {\n    if b > 1 {\n        None\n    } else { None }\n}\nmod inner;\nenum E { X }\n"


def test_c_facts():
    fs = {f[0]: f for f in C.c_functions(C_TEXT)}
    assert fs["add"][1:3] == (7, "int") and len(fs["add"][3]) == 2
    assert fs["main"][3] == []
    assert C.c_structs(C_TEXT) == [("Node", 2, [("int", "value"), ("char", "name")])]


def test_rust_facts():
    assert C.rust_functions(RUST_TEXT)[0][:3] == ("go", 5, "Option<u8>")
    assert C.rust_symbols(RUST_TEXT) == [("struct", "A", 1, 3), ("function", "go", 5, 9), ("module", "inner", 10, 10), ("enum", "E", 11, 11)]


@pytest.mark.parametrize("text,words", [("a b", ["a", "b"]), ("'a b' \"c d\"", ["a b", "c d"]), ("a\\ b", ["a b"]), ("", []), ("\"it's\"", ["it's"])])
def test_shell_words(text, words):
    assert C.shell_words(text) == words


def test_chunk_text():
    assert chunking.chunk_text("short", 100) == ["short"]
    text = "\n".join(f"line {i} of some text" for i in range(2000))
    parts = chunking.chunk_text(text, 2000)
    assert len(parts) > 1 and all(chunking.estimate(p) <= 2000 for p in parts)
    assert "\n".join(parts).split("\n") == text.split("\n")
    assert all(len(p) <= 2000 for p in chunking.chunk_text("word " * 10_000, 2000))


def test_split_by_functions(spark):
    text = "\n".join(["// head"] + [f"int f{i}(void) {{\n    x;\n    y;\n}}" for i in range(4)])
    df = spark.createDataFrame([("a", text), ("b", "no function\nhere"), ("c", ""), ("d", None)], "id string, code string")
    rows = chunking.split_by_functions(df, "id", "code", 8).orderBy("record_id", "chunk_no").collect()
    assert [(r.record_id, r.start_line, r.end_line) for r in rows] == [("a", 1, 9), ("a", 10, 17)]
    assert "\n".join(r.content for r in rows) == text
    both = {r.record_id for r in chunking.split_source(df, "id", "code", 60).collect()}
    assert both == {"a", "b"}


def test_run_and_resume(spark):
    chunks = spark.createDataFrame([("a", 0, "{x"), ("a", 1, "bad"), ("b", 0, "{y")], "record_id string, chunk_no int, content string")

    def work(t):
        if "{" not in t:
            raise ValueError
        return t, 0.9

    first = chunking.run_chunks(chunks, work)
    merged = {r.record_id: r for r in chunking.merge_chunks(first).collect()}
    assert merged["a"].confidence == 0.45 and merged["a"].returned_confidence == 0.9 and merged["a"].n_failed == 1
    again = {r.record_id: r for r in chunking.merge_chunks(chunking.resume_chunks(chunks, first, lambda t: (t, 0.5))).collect()}
    assert again["a"].n_failed == 0 and again["a"].confidence == 0.7


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    got = chunking.number_rows(df, ["x"]).orderBy("x").collect()
    assert [r.row_no for r in got] == list(range(1, 1001))
    assert chunking.number_rows(df.where("x < 0"), ["x"]).count() == 0


def test_line_edits(spark):
    df = spark.createDataFrame([("1\n2\n3\n4\n5\n",)], "t string")
    t = F.col("t")
    r = df.select(lines.read_range(t, 2, 4), lines.replace_range(t, 2, 4, "a\nb"), lines.delete_range(t, 2, 4), lines.insert_at(t, 2, "x"), lines.read_range(t, 2, 10), lines.around(t, F.lit(1), 1)).first()
    assert list(r) == ["2\n3\n4", "1\na\nb\n5", "1\n5", "1\nx\n2\n3\n4\n5", None, "   1: 1\n   2: 2"]


def test_key_errors(spark):
    text = "note\n --> skipped\nerror[E0382]: moved\n --> a.rs:1:2\n  | x\nplain"
    df = spark.createDataFrame([(text,), ("nothing",)], "t string")
    assert [r[0] for r in df.select(lines.key_errors(F.col("t"))).collect()] == ["error[E0382]: moved\n --> a.rs:1:2\n  | x", "nothing"]


def test_pairs(spark):
    rows = [("p", "src/a.c"), ("p", "include/a.h"), ("p", "src/a.h"), ("p", "src/b.cpp"), ("p", "lib/b.hpp"), ("w", "x\\d.c"), ("w", "y\\x\\d.hh"), ("w", "z/ad.h"), ("p", "note.txt"), ("q", "src/c.c"), ("p", "inc/c.h")]
    df = spark.createDataFrame(rows, "group_key string, path string")
    got = {(r.group_key, r.source_path): r.header_path for r in paths.pair_headers(df).collect()}
    assert got == {("p", "src/a.c"): "include/a.h", ("p", "src/b.cpp"): "lib/b.hpp", ("w", "x\\d.c"): "y\\x\\d.hh"}
    cats = {(r.group_key, r.path): r.category for r in paths.pairing_categories(df).collect()}
    assert cats[("q", "src/c.c")] == "individual" and cats[("p", "note.txt")] == "unrelated" and cats[("p", "src/a.h")] == "individual"


def test_human_size(spark):
    df = spark.createDataFrame([(1024,), (1048576,), (1536,), (5,)], "n long")
    assert [r[0] for r in df.select(paths.human_size(F.col("n"))).collect()] == ["1.00 KB", "1.00 MB", "1.50 KB", "5 B"]


def test_levels(spark):
    nodes = spark.createDataFrame([(1, x) for x in "abcdef"], "g long, n string")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "d", "e"), (1, "e", "d"), (1, "f", "c")], "g long, n string, needs string")
    got = {r.n: (r.level, r.outcome) for r in graph.topological_levels(nodes, edges, ["g", "n"]).collect()}
    assert got == {"a": (0, "done"), "b": (1, "done"), "c": (2, "done"), "f": (3, "done"), "d": (None, "blocked"), "e": (None, "blocked")}
    failed = spark.createDataFrame([(1, "b")], "g long, n string")
    got = {r.n: r.outcome for r in graph.topological_levels(nodes, edges, ["g", "n"], failed).collect()}
    assert got["b"] == "failed" and got["c"] == "blocked"


def test_resolve_includes(spark):
    nodes = spark.createDataFrame([(1, "src/c.c"), (1, "src/b.h"), (1, "include/a.h")], "relation_id long, path string")
    edges = spark.createDataFrame([(1, "src/c.c", "local", "b.h"), (1, "src/c.c", "local", "a.h"), (1, "src/c.c", "local", "z.h"), (1, "src/c.c", "system", "stdio.h")], "relation_id long, path string, include_kind string, include string")
    got = {r.include: r.resolved for r in graph.resolve_includes(nodes, edges, ["", "include"]).collect()}
    assert got == {"b.h": "src/b.h", "a.h": "include/a.h", "z.h": None}


def test_build_flags():
    assert graph.build_flags("cc -I inc -I/abs -Llib -l m -lpthread x.c", "/w") == {"include_dirs": ["/abs", "/w/inc"], "link_dirs": ["/w/lib"], "link_libs": ["m", "pthread"]}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [1.0, 1.0], 2), (4, None, 1), (5, [1.0, 0.0, 0.0], 1), (6, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in vectors.search(df, [1.0, 0.0]).collect()] == [1, 6, 3]
    assert [r.vec_id for r in vectors.search(df, [1.0, 0.0], threshold=0.9, label=1).collect()] == [1, 6]
    got = vectors.search_all(df, df.where("vec_id = 1"), 2).orderBy("position").collect()
    assert [r.vec_id for r in got] == [1, 6]


def test_threshold_search_is_unlimited(spark, data):
    assert "Limit" not in vectors.QUERIES["vector_threshold"](spark, data)._jdf.queryExecution().analyzed().toString()
    df = spark.createDataFrame([(i, [1.0, i / 100], 1) for i in range(30)], "vec_id long, embedding array<float>, label int")
    assert vectors.search(df, [1.0, 0.0], k=None, threshold=0.5).count() == 30


def test_page_beyond_the_fetch_limit():
    filler = "<p>" + "word " * 12_000 + "</p>"
    _, body, blocks = web.page_from_html(f"<body>{filler}<pre>int main() {{ return 0; }}</pre><p>the end</p></body>")
    assert body.endswith("the end") and [c for _, c in blocks] == ["int main() { return 0; }"]


def test_page_from_html():
    html = "<html><head><title>T &amp; x</title><style>no</style></head><body><nav>menu</nav><main><h1>Head</h1><p>Body<script>bad()</script></p><pre><code class='language-rust'>fn main() { go(); }</code></pre></main></body></html>"
    title, body, blocks = web.page_from_html(html)
    assert title == "Head" and body.startswith("HeadBody") and "bad" not in body
    assert blocks == [("language-rust", "fn main() { go(); }"), (None, "fn main() { go(); }")]


def test_search_results(spark):
    j = json.dumps({"AbstractText": "abs", "AbstractURL": "u", "RelatedTopics": [{"Text": "a - b", "FirstURL": "v"}, {"Name": "x"}], "Results": [{"Text": "c - d", "FirstURL": "w"}]})
    df = spark.createDataFrame([(1, j), (2, "no json"), (3, None)], "id long, t string")
    got = [(r.id, r.title, r.score) for r in web.search_results(df, "t").collect()]
    assert got == [(1, "Abstract", 0.9), (1, "Related: a", 0.7), (1, "c", 0.8)]


def test_keywords(spark):
    rows = [(1, '"E0382"|error_code|1.0\nmoved value|concept|0.8\n# note\nbad|x|y'), (2, 'use "borrow checker" and `abc`'), (3, "an ownership problem"), (4, ""), (5, None)]
    got = diagnosis.parse_keywords(spark.createDataFrame(rows, "id long, t string"), "id", "t").orderBy("id", "position").collect()
    first = [(r.keyword, r.relevance) for r in got if r.id == 1]
    assert first == [("E0382", 1.0), ("bad", 1.0), ("moved value", 0.8)]
    assert [r.keyword for r in got if r.id == 2] == ["borrow checker"]
    assert [r.keyword for r in got if r.id == 3] == ["ownership"]
    assert [r.category for r in got if r.id in (4, 5)] == ["fallback", "fallback"]


@pytest.mark.parametrize(
    "response,code",
    [
        ('{"rust_code": "fn a() {}"}', "fn a() {}"),
        ('```json\n{"rust_code": "fn a() {}"}\n```', "fn a() {}"),
        ("```rust\nfn a() {}\n```", "fn a() {}"),
        ('{"choices": [{"message": {"content": "fn a() {}"}}]}', "fn a() {}"),
        ('{"rust_code": "fn a() {\\n}", "x', "fn a() {\n}"),
        ("```\nfn a() {}\n```", "fn a() {}"),
        ("fn a() {}", "fn a() {}"),
    ],
)
def test_answers(spark, response, code):
    df = spark.createDataFrame([(response,)], "t string")
    assert df.select(diagnosis.rust_code_of(F.col("t"))).first()[0] == code


def test_files(spark, tmp_path):
    for p, t in (("src/a.c", "int a;"), ("inc/a.h", "x"), ("b.o", "x"), ("target/c.rs", "x"), ("d.rs", "x")):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    root = str(tmp_path)
    assert {r.path for r in files.scan(spark, root).collect()} == {"src/a.c", "inc/a.h", "target/c.rs", "d.rs"}
    assert {r.path for r in files.scan_c(spark, root).collect()} == {"src/a.c", "inc/a.h"}
    assert {r.path for r in files.scan_sources(spark, root).collect()} == {"src/a.c", "inc/a.h", "d.rs"}
    assert files.has_c_files(spark, root)
    db = tmp_path / "compile_commands.json"
    db.write_text(json.dumps([{"file": "a.c", "directory": "/w", "command": "cc -Iinc a.c"}, {"file": "b.c", "directory": "/w", "arguments": ["cc", "-lm", "b.c"]}]))
    commands = files.compile_commands(spark, str(db))
    flags = {r.file: r for r in files.command_flags(commands, "/w").collect()}
    assert flags["a.c"].include_dirs == ["/w/inc"] and flags["b.c"].link_libs == ["m"]
    assert files.command_of(commands, "b.c").count() == 1
    assert files.find_upwards(str(tmp_path / "src"), "compile_commands.json") == str(db)


def test_manifests():
    got = files.manifest_facts('[workspace]\nmembers = ["a", "b"]\n[dependencies]\nlibc = "0.2"\n[[bin]]\nname = "x"\n')
    assert got == {"dependencies": ["libc"], "members": ["a", "b"], "has_bin": True}
    assert files.manifest_facts("not toml [")["dependencies"] == []


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[sqlite]\npath = "db.sqlite"\n[task]\nn = 0\n')
    c = files.load_config([str(tmp_path / "none.toml"), str(p)])
    assert c["sqlite"]["path"] == os.path.join(str(tmp_path), "db.sqlite")
    issues = files.config_issues(c, [("task.n", "error", "min", 1), ("task.m", "warning", "required", None)])
    assert [(i["level"], i["field"]) for i in issues] == [("error", "task.n"), ("warning", "task.m")]


def test_ast():
    tree = {"kind": "TranslationUnitDecl", "inner": [{"kind": "FunctionDecl", "name": "f", "loc": {"line": 3}, "inner": [{"kind": "VarDecl", "name": "v"}]}]}
    assert files.ast_facts(json.dumps(tree)) == [("function", "f", 3), ("variable", "v", None)]
    assert files.ast_facts("{") == []


def test_store(spark, tmp_path):
    store = MetadataStore(spark, str(tmp_path / "db"))
    store.bootstrap()
    store.bootstrap()
    store.insert_entries(spark.createDataFrame([("a", "x", "c", "p1"), ("", "y", None, "p1"), ("b", "z", "rust", "p2")], "id string, code string, language string, project string"))
    e = store.read("code_entries")
    assert e.count() == 3 and e.where("language = 'c'").count() == 2 and e.where("id = ''").count() == 0
    store.insert_conversions(spark.createDataFrame([("k1", "a", "o", "n", "c_to_rust", "success"), ("k2", "zz", "o", "n", "c_to_rust", "success")], "id string, source_id string, original_code string, converted_code string, conversion_type string, status string"))
    assert [r.id for r in store.read("conversion_results").collect()] == ["k1"]
    assert store.update_entries(spark.createDataFrame([("a", "new"), ("none", "q")], "id string, code string")) == 1
    assert store.read("code_entries").where("id = 'a'").first().code == "new"
    store.upsert_vectors(spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>"))
    store.upsert_vectors(spark.createDataFrame([("a", [2.0]), ("a", [2.0])], "id string, embedding array<float>"))
    assert [list(r.embedding) for r in store.read("vectors").collect()] == [[2.0]]
    store.set_setting("k", "1")
    store.set_setting("k", "2")
    store.seed_settings()
    store.seed_settings()
    assert store.read("code_entries").where("language = 'config'").count() == 2 + 6
    store.create_project("p1", "/w/p1")
    store.delete_entries(spark.createDataFrame([("a",)], "id string"))
    assert store.read("conversion_results").count() == 0 and store.read("vectors").count() == 0
    store.clear_project("p2")
    store.compact("code_entries")
    assert store.read("code_entries").where("id = 'b'").count() == 0
    store.insert_interfaces(spark.createDataFrame([("v1", "x", [1.0, 2.0])], "id string, code string, embedding array<float>"))
    assert store.read("vectors").count() == 1
    store.store_facts(spark.createDataFrame([("f", "a.c", "{}")], "name string, file string, result string"), "function_definition", "p")
    assert store.read("analysis_results").count() == 1
    store.views()
    assert spark.sql("SELECT count(*) FROM analysis_results").first()[0] == 1


def test_fetch(spark):
    fetch.register(spark)
    df = spark.read.format("millrace_fetch").option("keys", "a\nb").option("fetcher", "builtins:str").load()
    assert sorted((r.key, r.text, r.error) for r in df.collect()) == [("a", "a", None), ("b", "b", None)]
    none = spark.read.format("millrace_fetch").option("keys", "a").load()
    assert none.first().error == "no fetcher"
