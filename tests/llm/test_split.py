from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import split


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab {};\n\r\té编", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_fit_and_cover(text, limit, overlap):
    ps = split.pieces(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in ps) == text
    for k, (o, s, e) in enumerate(ps):
        assert 0 < e - s and e - o <= limit
        if k:
            before = text[ps[k - 1][0] : ps[k - 1][2]]
            assert text[o:s] == before[-overlap:] if overlap else o == s


def test_prefers_strong_boundaries():
    block = "int f() {\n" + "    x = 1;\n" * 20 + "}\n\n"
    ends = [e for _, _, e in split.pieces(block * 6, 500, 20)]
    assert all((block * 6)[:e].endswith("}\n\n") for e in ends)


def test_operator(spark):
    rows = [("a", "x" * 6001), ("b", "x" * 6000), ("c", None), ("d", ""), ("e", "line\n" * 100_000), ("a", "x" * 6001), (None, "y" * 7000)]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "id string, code string, record_id string, piece_no int")
    got = split.split_oversized(df, "id", "code").collect()
    assert {r.record_id for r in got} == {"a", "e", None}
    assert sum(r.record_id == "a" for r in got) == 4 and all(len(r.piece) <= 6000 for r in got)
    assert all(r.piece_no <= r.n_pieces for r in got)
    assert split.split_oversized(df.limit(0), "id", "code").count() == 0
