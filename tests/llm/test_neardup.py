import itertools
import random

from pyspark.sql import functions as F

from millrace.llm import neardup

SCHEMA = "id string, code string, language string, text_key string, lines string, n_lines int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def brute(rows):
    sets = {}
    for i, code, lang in rows:
        if i is not None and code is not None and (lang or "").strip().lower() not in ("project", "config"):
            got = set(neardup.line_set(code, "python" if (lang or "").lower() in ("py", "python") else (lang or "")))
            if got:
                sets[i] = got
    return {tuple(sorted((a, b))) for a, b in itertools.combinations(sets, 2) if 4 * len(sets[a] & sets[b]) >= 3 * max(len(sets[a]), len(sets[b]))}


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for g in range(60):
        n = rng.choice([1, 2, 3, 4, 5, 8, 13, 20, 40, 90])
        base = [f"{word()} = {word()}({rng.randint(0, 9999)});" if rng.random() < 0.75 else rng.choice(["}", "break;", "do {", "default:"]) for _ in range(n)]
        for k in range(rng.randint(1, 5)):
            lines = list(base)
            for _ in range(rng.randint(0, max(1, n // 4))):
                op = rng.random()
                at = rng.randrange(len(lines) + 1)
                if op < 0.4:
                    lines.insert(at, f"{word()}++;")
                elif op < 0.7 and len(lines) > 1:
                    lines.pop(at % len(lines))
                else:
                    lines[at % len(lines)] = f"{word()}--;"
            if rng.random() < 0.4:
                rng.shuffle(lines)
            text = rng.choice(["\n", "\r\n"]).join(rng.choice(["", "  ", "\t"]) + ln + rng.choice(["", "  // " + word()]) for ln in lines)
            rows.append((f"{g:03}-{k}", text, rng.choice(["c", "C ", "rust"])))
    return rows


def test_no_pair_is_lost(spark):
    for seed in (1, 2, 3):
        rows = planted(seed)
        got = {tuple(r) for r in neardup.found_pairs(frame(spark, rows)).collect()}
        want = brute(rows)
        assert len(want) > 100
        assert got == want


def test_no_pair_is_lost_at_the_threshold(spark):
    """Short texts with exactly three quarters in common, most of that in lines that many texts have."""
    rng = random.Random(5)
    pool = [f"common_{i}();" for i in range(30)]
    rows = []
    for g in range(300):
        n = rng.choice([8, 12, 16, 24, 40])
        both = rng.sample(pool, n // 2) + [f"both_{g}_{i}();" for i in range(n // 4)]
        rows += [(f"{g:03}-{side}", "\n".join(both + [f"own_{g}_{side}_{i}();" for i in range(n // 4)]), "c") for side in "ab"]
    got = {tuple(r) for r in neardup.found_pairs(frame(spark, rows)).collect()}
    want = brute(rows)
    assert len(want) >= 300
    assert got == want


def test_no_planted_pair_is_lost(spark):
    for seed in (1, 2, 3):
        rows = planted(seed)
        assert {tuple(r) for r in neardup.found_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_hot_group_of_near_copies(spark):
    base = [f"value_{i} = call_{i}();" for i in range(30)]
    rows = [(f"h{k:03}", "\n".join(base[:k % 30] + [f"own_{k} = 1;"] + base[k % 30 + 1 :]), "c") for k in range(120)]
    rows += [(f"s{k:03}", "\n".join(f"x_{k}_{i} = {i};" for i in range(20)), "c") for k in range(100)]
    got = {tuple(r) for r in neardup.found_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_defined_results(spark):
    rows = [
        ("a", "x = 1;\ny = 2;", "c"), ("b", "y = 2; // note\r\n\r\n   x = 1;", None), ("b", "y = 2; // note\r\n\r\n   x = 1;", None), ("c", None, "c"), ("d", "", "c"),
        ("e", "/* only a comment */", "c"), ("f", "x = 1;\ny = 2;", "config"), (None, "x = 1;\ny = 2;", "c"), ("g", "z();\n" * 30_000, "c"), ("h", "z();\n" * 30_000 + "w();", "c"),
    ]
    df = frame(spark, rows)
    assert {tuple(r) for r in neardup.found_pairs(df).collect()} == {("a", "b"), ("g", "h")}
    groups = {r.id: (r.group_id, r.n_links) for r in neardup.duplicate_groups(df).collect()}
    assert set(groups) == {"a", "b", "g", "h"}
    assert groups["a"] == groups["b"] and groups["g"][0] == groups["h"][0] and groups["g"][1] == 1


def test_empty(spark):
    assert neardup.found_pairs(frame(spark, [])).count() == 0
    assert neardup.duplicate_groups(frame(spark, [])).count() == 0


def test_comments():
    assert neardup.code_lines('a("// no"); // yes\n/* x\n y */ b();\n\n', "c") == ['a("// no");', "b();"]
    assert neardup.code_lines("a = '#' # yes\n# all\n  b = 1", "python") == ["a = '#'", "b = 1"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 9)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(edges, "a", "b").collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (7, 8, 9)} == {7}
    assert {got[100 + i] for i in range(41)} == {100}


def test_rungs_cover_partners():
    for n in range(1, 400):
        for m in range(n, n * 4 // 3 + 1):
            assert set(neardup.rungs(n)) & set(neardup.rungs(m)), (n, m)


def test_counts_on_all_tables(spark, data):
    e = spark.read.parquet(f"{data}/code_entries.parquet")
    rows = [(r.id, r.code, {"py": "python", "python": "python"}.get((r.language or "").strip().lower(), r.language)) for r in e.select("id", "code", F.col("language")).collect()]
    assert {tuple(r) for r in neardup.found_pairs(e).collect()} == brute(rows)


def test_all_meetings(spark):
    rng = random.Random(8)
    rows = [(1, k) for k in range(700)] + [(2, k) for k in range(40)] + [(v, rng.randrange(1000)) for v in range(3, 60) for _ in range(6)]
    rows = sorted(set(rows))
    balls = spark.createDataFrame(rows, "variant long, key long")
    got = [tuple(r) for r in neardup.meetings(balls).collect()]
    want = {(v, a, b) for v in {r[0] for r in rows} for a, b in itertools.combinations(sorted(k for w, k in rows if w == v), 2)}
    assert set(got) == want and len(got) == len(want)


def test_keys_that_two_texts_share(spark):
    rows = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 1), ("d", 6, 1)], "id string, text_key long, check long")
    got = {r.id: r.text_key for r in neardup.unique_keys(rows).collect()}
    assert got["a"] == got["c"] != got["b"] and got["d"] == 6


def test_hot_variants_are_dealt_over_tasks(spark):
    """A partition that one variant fills is split at run time."""
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2048", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        balls = spark.range(6000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).cast("long").alias("variant"), F.col("id").alias("key")).repartition(8)
        met = neardup.meetings(balls)

        assert met._jdf.queryExecution().toRdd().count() == 2000 * 1999 // 2
        assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
