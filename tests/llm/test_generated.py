import random

from millrace.llm import generated

ENTRY = "id string, code string, language string, project string, file_path string, features string, label double"
MAP = "mapping_id string, project string, source_path string, path string"


def hand(rng, k):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    body = "\n".join(f"    {rng.choice(words)}_{rng.choice(words)} = compute_{rng.choice(words)}({rng.randint(0, 99)});" for _ in range(12))
    return f"#include <stdio.h>\n\n/* does the work of {k} */\nstatic int work_{k}(int {rng.choice(words)})\n{{\n{body}\n    return 0;\n}}\n"


def minified(rng):
    return "".join(f"function {a}{b}({a},{b}){{return {a}.x?{b}:{rng.randint(0, 999)}}}" for a, b in [(rng.choice("abcdef"), rng.choice("ghijk")) for _ in range(25)])


def entries(spark):
    rng = random.Random(4)
    rows = [(f"h{k}", hand(rng, k), "c", "Proj", f"src/h{k}.c") for k in range(150)]
    rows += [(f"m{k}", minified(rng), "js", "Proj", f"web/m{k}.min.js" if k % 2 else f"web/m{k}.js") for k in range(120)]
    rows += [(f"t{k}", f"static const uint8_t t[{30 + k}] = {{" + "0x12, " * (30 + k) + "};\n" + hand(rng, f"t{k}"), "c", "proj", f"src/t{k}.c") for k in range(16)]
    rows += [
        ("g1", "// Code generated by tool. DO NOT EDIT.\n" + hand(rng, "g1"), "c", "proj", "src/g1.c"),
        ("g2", hand(rng, "g2"), "c", "/srv/PROJ/", "src/g1.c"),
        ("n1", "// do not edit the order of the fields, the pool depends on it\n" + hand(rng, "n1"), "c", "proj", "src/n1.c"),
        ("n2", "// written by hand, was generated by x until the parser was dropped\n" + hand(rng, "n2"), "c", "proj", "src/n2.c"),
        ("n3", hand(rng, "n3"), "c", "proj", "src/vendor_api/n3.c"),
        ("n4", "static const uint8_t t[40] = {" + "0x12, " * 40 + "};\n" + hand(rng, "n4"), "c", "proj", "tools/generator/n4.c"),
        ("v1", hand(rng, "v1"), "c", "proj", "third_party/zlib/v1.c"),
        ("v2", "/* Imported unchanged from zlib-1.2.3; send fixes upstream. */\n" + hand(rng, "v2"), "c", "proj", "lib/v2.c"),
        ("v3", hand(rng, "v3"), "c", None, "deps/foo-1.2.3/v3.c"),
        ("b1", "const unsigned char t[] = {" + "0x1f, " * 900 + "};", "c", "proj", "src/b1.c"),
        ("c1", "// Code generated by x. DO NOT EDIT.", "config", "proj", "c1"),
        ("e1", None, "c", "proj", "build/e1.c"),
        ("e2", None, "c", "proj", None),
        ("e3", "", None, None, None),
        ("l1", "// " + "long words of a comment " * 20_000 + "\n" + hand(rng, "l1"), "c", "proj", "src/l1.c"),
    ]
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], ENTRY)


def mappings(spark):
    rows = [("p1", "proj", "/srv/checkouts/proj/src/g1.c"), ("p2", None, "proj\\src\\h1.c"), ("p3", "proj", "./proj/third_party/zlib/v1.c"), ("p4", "proj", None), ("p5", "gone", "gone/vendor/x/y.c"), ("p6", "proj", "proj/deps/foo-1.2.3/v3.c"), ("p7", "other", "/vendor/other/src/a.c")]
    return spark.createDataFrame([(*r, "clash") for r in rows], MAP)


def test_records(spark):
    e, m = entries(spark), mappings(spark)
    got = {tuple(r) for r in generated.made_records(e, m).collect()}
    code = {i for t, i in got if t == "code_entries"}
    assert code == {f"m{k}" for k in range(120)} | {"g1", "g2", "v1", "v2", "v3", "b1", "e1"}
    assert {i for t, i in got if t == "file_mappings"} == {"p1", "p3", "p5", "p6"}
    twice = {tuple(r) for r in generated.made_records(e.unionAll(e), m.unionAll(m)).collect()}
    assert twice == got


def test_empty(spark):
    e, m = entries(spark).limit(0), mappings(spark).limit(0)
    assert generated.made_records(e, m).count() == 0


def test_forest_votes_on_unlabelled_files(spark):
    looks = generated.entry_looks(entries(spark))
    votes = {r.id: r.by_look for r in generated.forest_votes(looks, looks).collect()}
    assert all(votes[f"m{k}"] for k in range(120)) and not any(votes[f"h{k}"] for k in range(150))


def test_forest_finds_what_it_did_not_see(spark):
    rng = random.Random(9)
    rows = [(f"h{k}", hand(rng, k), "c", "Proj", f"src/h{k}.c") for k in range(300)]
    rows += [(f"m{k}", minified(rng), "js", "Proj", f"web/m{k}.min.js" if k % 2 else f"web/m{k}.js") for k in range(80)]
    rows += [(f"b{k}", f"const unsigned char t{k}[] = {{\n" + "\n".join(", ".join(f"0x{rng.randint(0, 255):02x}" for _ in range(12)) + "," for _ in range(60)) + "\n};", "c", "proj", f"src/b{k}.c") for k in range(40)]
    looks = generated.entry_looks(spark.createDataFrame([(*r, "clash", 1.0) for r in rows], ENTRY))
    got = {r.evidence: (r.n_records, r.n_found) for r in generated.forest_check(looks).collect()}
    assert got["name"][1] >= 0.9 * got["name"][0] and got["data"][1] >= 0.9 * got["data"][0]
    # minified files without a telling name are found, hand-written ones are not
    assert 36 <= got["none"][1] <= 40 and got["none"][0] == 340


def test_one_label_fits_no_forest(spark):
    looks = generated.entry_looks(entries(spark).where("id LIKE 'h%'"))
    assert not any(r.by_look for r in generated.forest_votes(looks, looks).collect())
