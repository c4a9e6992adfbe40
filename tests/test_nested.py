import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import nested

SCHEMA = "relation_id long, relation string, relation_text string, path string"


def rebuild(text):
    """The value of a JSON text from its triples."""
    root = [None]
    for path, value, kind in nested.stream_triples(text):
        new = {} if kind == "object" else [] if kind == "array" else value if kind == "string" else None if kind == "null" else json.loads(value)
        if not path:
            root[0] = new
            continue
        at = root[0]
        for p in path[:-1]:
            at = at[p]
        if isinstance(at, list):
            at.append(new)
        else:
            at[path[-1]] = new
    return root[0]


values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(values, st.booleans())
def test_triples_round_trip(value, spaced):
    assert rebuild(json.dumps(value, indent=2 if spaced else None)) == value


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", "nul", '{"a":}', "[1]]", '"\\x"', "01", '{"a":1} x', '{1:2}', '["a', "]"])
def test_broken(text):
    with pytest.raises(ValueError):
        list(nested.stream_triples(text))
    assert nested.group_triples(text) == []


def test_variants(spark):
    node = {"path": "a.c", "local_includes": ["x.h", "x.h", {"path": "y.h", "line": 3}], "system_includes": "stdio.h"}
    rows = [
        (1, json.dumps({"workspace": "/w", "files": [node, {"path": "b.c", "local_includes": None}]})),
        (2, json.dumps({"version": 2, "payload": {"relation": {"workspace": "/w", "files": {"k.c": {"system_includes": ["m.h"]}}}}})),
        (3, json.dumps({"files": {"dir": "", "files": [], "dirs": [{"dir": "s", "files": [{"path": "s/t.c", "local_includes": ["u.h"]}], "dirs": []}]}})),
        (4, None),
        (5, '{"files": ['),
        (6, ""),
        (1, json.dumps({"workspace": "/w", "files": [node]})),
        (7, json.dumps({"files": [{"path": "long.c", "system_includes": ["z" * 200_000]}]})),
    ]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = {tuple(r) for r in nested.distinct_includes(df).collect()}
    assert got == {
        (1, "a.c", "local", "x.h"), (1, "a.c", "local", "y.h"), (1, "a.c", "system", "stdio.h"),
        (2, "k.c", "system", "m.h"), (3, "s/t.c", "local", "u.h"), (7, "long.c", "system", "z" * 200_000),
    }
    triples = nested.relation_triples(df)
    assert {r.relation_id for r in nested.relation_table(triples).collect()} == {1, 2, 3, 7}
    nodes = {(r.relation_id, r.path) for r in nested.node_table(triples).collect()}
    assert nodes == {(1, "a.c"), (1, "b.c"), (2, "k.c"), (3, "s/t.c"), (7, "long.c")}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nested.distinct_includes(df).count() == 0
    assert nested.relation_table(nested.relation_triples(df)).count() == 0


def test_unknown_members_are_kept(spark):
    text = '{"files":[{"path":"a","owners":[{"name":"x"}],"meta":{"k":1}}],"extra":[{"p":1}],"n":5}'
    df = spark.createDataFrame([(1, text, "clash", "clash"), (1, text, "clash", "clash"), (2, "{", "c", "c")], SCHEMA)
    tables = nested.group_tables(nested.flatten_records(df, "relation_id", "relation"), "relation_id")
    got = {g: [r.asDict() for r in t.collect()] for g, t in tables.items()}
    assert {g: len(r) for g, r in got.items()} == {"record": 1, "files[]": 1, "files[].owners[]": 1, "extra[]": 1}
    assert got["record"][0]["n"] == "5" and got["extra[]"][0]["p"] == "1"
    assert got["files[]"][0]["path"] == "a" and got["files[]"][0]["meta.k"] == "1"
    owner = got["files[].owners[]"][0]
    assert owner["name"] == "x" and owner["parent"] == got["files[]"][0]["row"]


def test_groups_within_groups():
    def groups(value):
        return {r[0] for r in nested.group_triples(json.dumps(value))}

    tree = {"dirs": [{"dir": "a", "dirs": [{"dir": "b", "dirs": [{"dir": "c"}]}]}]}
    assert groups(tree) == {"record", "dirs[]"}
    assert groups({"by_path": {"src/a.c": {"n": 1}, "Makefile": {"n": 2}}}) == {"record", "by_path{}"}
    assert groups({"point": {"x": {"v": 1}, "y": {"v": 2}}}) == {"record"}
    assert groups({"m": [[1, 2], [3]]}) == {"record", "m[]", "m[].[]"}


def test_deep_and_wide(spark):
    deep = "[" * 3000 + "]" * 3000
    assert len(nested.group_triples(deep)) == 3000
    wide = json.dumps({f"f{k}": k for k in range(30)})
    df = spark.createDataFrame([(1, wide, "c", "c")], SCHEMA)
    row = nested.group_tables(nested.flatten_records(df, "relation_id", "relation"), "relation_id", most_fields=10)["record"].first()
    assert len(row.rest) == 20 and sum(int(row[f"f{k}"]) for k in range(30) if f"f{k}" in row.asDict()) + sum(map(int, row.rest.values())) == sum(range(30))


@settings(max_examples=100, deadline=None)
@given(values)
def test_every_scalar_is_one_field(value):
    def scalars(v):
        return sum(map(scalars, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else 1

    assert sum(r[6] is not None for r in nested.group_triples(json.dumps(value))) == scalars(value)
