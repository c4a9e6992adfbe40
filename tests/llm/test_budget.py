import pyarrow as pa
import pytest

pytest.importorskip("tiktoken")

from millrace.llm import budget
from millrace.llm.vocab import TOKENIZER_DIR, count_tokens

DOC = "doc_id long, text string, lang string, source string, domain string, id string, language string, bytes long"


def test_features():
    x = budget.text_features(pa.array(["ab cd 12!\n", "", "É编", "x"]))
    got = dict(zip(budget.FEATURES, x[0]))
    assert got["bytes"] == 10 and got["words"] == 2 and got["digits"] == 2 and got["punct"] == 1 and got["breaks"] == 1
    assert not x[1].any() and x[2][budget.FEATURES.index("latin")] == 1 and x[2][budget.FEATURES.index("cjk")] == 1
    assert x[3][budget.FEATURES.index("words")] == 1
    assert (budget.text_features(pa.array(["zz", "ab cd 12!\n"]).slice(1)) == x[0]).all()


def test_holdout_error(spark, data):
    models = {r.language: r for r in budget.fit_models(budget.code_slices(spark.read.parquet(f"{data}/code_entries.parquet"))).collect()}
    assert models["c"]["holdout_error"] < 0.15 and 0.8 < models["c"]["bias"] < 1.2


def test_total_is_near(spark, data):
    slices = budget.document_slices(spark.read.parquet(f"{data}/documents.parquet"))
    out = budget.token_budget(slices, "documents").collect()
    true = sum(count_tokens([r.text for r in slices.collect()], "byte_bpe_50k", TOKENIZER_DIR))
    assert abs(sum(r.est_tokens for r in out) - true) < 0.06 * true
    assert sum(r.n_records for r in out) == slices.count()


def test_defined_results(spark):
    rows = [(1, "some text here", "en", "A ", None), (1, "some text here", "EN", "a", "d"), (2, None, None, None, "d"), (3, "", "en", "a", "d"), (4, "编译器" * 50_000, "zh", "A", "d")]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], DOC)
    got = {(r.source, r.language, r.domain): (r.n_records, r.n_bytes) for r in budget.token_budget(budget.document_slices(df), "documents").collect()}
    assert got == {("a", "en", "unknown"): (1, 14), ("a", "en", "d"): (2, 14), ("unknown", "unknown", "d"): (1, 0), ("a", "zh", "d"): (1, 450_000)}
    assert budget.token_budget(budget.document_slices(df.limit(0)), "documents").count() == 0
    code = spark.createDataFrame([("a", "int x;", " C99", "/srv/Checkouts/Foo/", '{"domain": "net", "return_type": "in'), ("b", "x", "config", "p", None)], "id string, code string, language string, project string, metadata string")
    r = budget.token_budget(budget.code_slices(code), "code_entries").collect()
    assert [(x.source, x.language, x.domain, x.n_records) for x in r] == [("foo", "c", "net", 1)]


def test_languages_beyond_the_most_frequent(spark):
    plain, odd = "the quick brown fox jumps over the lazy dog and so on ", "4711 0815 99 314159 27 1828 "
    rows = [(f"{k}-{i}", f"l{k:02}", plain * (1 + i % 5)) for k in range(64) for i in range(45)]
    rows += [(f"x{k}-{i}", f"x{k:02}", odd * (1 + i % 7)) for k in range(12) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, language string, text string")
    models = budget.fit_models(df)
    got = budget.estimate_tokens(df.where("language LIKE 'x%'"), ["language"], models).agg({"est_tokens": "sum"}).first()[0]
    true = sum(count_tokens([t for _, lang, t in rows if lang[0] == "x"], "byte_bpe_50k", TOKENIZER_DIR))
    assert abs(got - true) < 0.1 * true


def test_every_language_has_its_model(spark):
    """Seventy languages whose texts take very different numbers of tokens a byte."""
    texts = ["the quick brown fox and so on ", "4711 0815 99 314159 27 ", "xq zv jk wq pf vb ", "{}();[]<>!= "]
    rows = [(f"{k}-{i}", f"l{k:02}", texts[k % 4] * (1 + (i * 7 + k) % 9)) for k in range(70) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, language string, text string")
    models = budget.fit_models(df)
    assert {r.language for r in models.collect()} == {f"l{k:02}" for k in range(70)}
    got = {r.language: r.est_tokens for r in budget.estimate_tokens(df, ["language"], models).collect()}
    for k in range(70):
        true = sum(count_tokens([t for _, lang, t in rows if lang == f"l{k:02}"], "byte_bpe_50k", TOKENIZER_DIR))
        assert abs(got[f"l{k:02}"] - true) < 0.03 * true


def test_few_rows_of_one_language(spark):
    rows = [(f"a{i}", "en", "some plain words here " * (1 + i % 6)) for i in range(80)] + [("b", "de", "ein paar Worte hier")]
    df = spark.createDataFrame(rows, "id string, language string, text string")
    got = {r.language: r.est_tokens for r in budget.estimate_tokens(df, ["language"], budget.fit_models(df)).collect()}
    assert 2 < got["de"] < 12
