import pytest

pytest.importorskip("tiktoken")
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing

DOC = "doc_id long, text string, source string, n_tokens long, text_key string, range int"


def test_flow():
    total, f = mixing.min_cost_flow([("s", "a", 5, 1), ("s", "b", 5, 0), ("a", "t", 9, 0), ("b", "a", 9, 2), ("b", "t", 1, 0)], "s", "t")
    assert total == 10 and f[0] == 5 and f[4] == 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")]), st.integers(1, 1000), min_size=1), st.integers(1, 4))
def test_route_reaches_shares(patterns, repeats):
    targets = {"a": (0.5, repeats), "b": (0.3, 1), "c": (0.2, 2)}
    total, flows = mixing.route({p: float(v) for p, v in patterns.items()}, targets)
    live = {s for p in patterns for s in p}
    scale = sum(targets[s][0] for s in live)
    for s in live:
        got = sum(f for (_, _, x), f in flows.items() if x == s)
        assert got == pytest.approx(targets[s][0] / scale * total, rel=1e-3, abs=1e-3)
    for p, v in patterns.items():
        for k in range(1, 5):
            assert sum(f for (q, j, _), f in flows.items() if (q, j) == (p, k)) <= v * (1 + 1e-6)
    assert all(k <= targets[s][1] for (_, k, s) in flows)


def test_mix(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 50), "Big") for i in range(400)]
    rows += [(1000 + i, f"small one {i} " + "thing " * (i % 30), "small ") for i in range(60)] + [(2000 + i, f"text number {i} " + "word " * (i % 50), "small") for i in range(20)]
    rows += [(5000, None, "big"), (5001, "", "big"), (5002, "other", None), (1, rows[1][1], "big"), (6000, "long " * 30_000, "unused")]
    df = spark.createDataFrame([(*r, 7, "clash", 1) for r in rows], DOC)
    targets = spark.createDataFrame([("big", 0.6, 1, "x"), ("small", 0.3, 3, "x"), ("absent", 0.1, 5, "x")], "source string, target_share double, max_repeats int, n_uses string")
    mixed = mixing.mix(df, targets).collect()
    cap = {"big": 1, "small": 3}
    assert all(1 <= r.n_uses <= cap[r.source] for r in mixed)
    assert len({(r.doc_id, r.source) for r in mixed}) == len(mixed)
    got = {r.source: r for r in mixing.shares(mixing.mix(df, targets), targets).collect()}
    assert got["absent"].actual_share == 0 and abs(got["big"].actual_share - 2 / 3) < 0.03 and abs(got["small"].actual_share - 1 / 3) < 0.03
    again = sorted(tuple(r) for r in mixing.mix(df.repartition(5), targets).collect())
    assert again == sorted(tuple(r) for r in mixed)
    # a text in both sources is used up to the larger cap
    use: dict = {}
    text = {r[0]: r[1] for r in rows}
    for r in mixed:
        use[text[r.doc_id]] = use.get(text[r.doc_id], 0) + r.n_uses
    assert max(use.values()) <= 3


def test_empty(spark):
    df = spark.createDataFrame([], DOC)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, targets).count() == 0
    assert [r.actual_share for r in mixing.shares(mixing.mix(df, targets), targets).collect()] == [0.0]
    assert mixing.mix(df, targets.limit(0)).count() == 0
