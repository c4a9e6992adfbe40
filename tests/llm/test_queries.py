"""The registered queries run over whole tables; those with SQL agree with DuckDB."""

import glob
import os
import re

import duckdb
import pytest

from millrace.llm import queries as Q

COLUMNS = {
    "p2_found": {"record_table", "record_id"}, "p3_found": {"id_a", "id_b"}, "p5_found": {"record_table", "record_id"}, "p6_found": {"record_table", "record_id"},
    "p7_found": {"page_id", "line_no"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id", "reading_level"},
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)
    if name in Q.ORACLE_SQL:
        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        r = c.execute(Q.ORACLE_SQL[name])
        at = [[d[0] for d in r.description].index(x) for x in df.columns]
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


def test_nothing_else_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for f in glob.glob(f"{root}/millrace/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert not re.search(r"millrace\.llm|from millrace import llm", "".join(ln for ln in open(f) if not ln.lstrip().startswith(("``", '"'))).replace("``millrace.llm``", "")), f
