import random

import numpy as np

from millrace.llm import reading

DOC = "doc_id long, text string, lang string, domain string, reading_level string, level double, word string"
EASY, MID, HARD = "cat dog hat sun big red run sit see put".split(), "buffer pointer thread compile memory struct error module string version".split(), "monotone semantics coherence bisimulation lattice denotational quiescent parametricity adjoint fibration".split()
SHARED = "the a of and is to in that it with".split()


def documents(spark, n=120):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(n):
        level = i % 3
        pool = (EASY, MID, HARD)[level]
        other = (EASY, MID, HARD)[(level + 1) % 3 if level == 0 else 1]
        words = [rng.choice(SHARED) if rng.random() < 0.5 else rng.choice(pool if rng.random() < 0.85 else other) for _ in range(80)]
        rows.append((i, " ".join(words) + ".\n```c\nint x = 1;\n```\n", "en", "tutorial"))
        truth[i] = level + 1
    rows += [(900, None, "en", "tutorial"), (901, "", "en", "tutorial"), (902, "few words only", "en", "tutorial"), (903, "hallo " * 30, "de", "tutorial"), (904, "code " * 30, "en", "commit_log"), (905, "`x` " * 30, "en", "api_doc"), (906, "cat dog sun " * 20_000, "en", "design_note")]
    rows += [rows[0]]
    return spark.createDataFrame([(*r, "clash", 1.0, "clash") for r in rows], DOC), truth


def labels(spark, truth, ids):
    return spark.createDataFrame([(i, truth[i], "clash", 0.5) for i in ids] + [(None, 1, "c", 0.0), (1, None, "c", 0.0), (90001, 2, "c", 0.0)], "doc_id long, reading_level long, text string, anchor double")


def test_held_out(spark):
    df, truth = documents(spark)
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(df, labels(spark, truth, range(0, 30))).collect()}
    assert set(got) == set(truth) | {905, 906}
    held = [i for i in truth if i >= 30]
    assert np.mean([got[i] == truth[i] for i in held]) > 0.97
    assert got[906] == 1
    assert len(got) == len(truth) + 2


def test_without_labels_or_rows(spark):
    df, truth = documents(spark, 30)
    none = labels(spark, truth, []).limit(0)
    got = reading.reading_levels(df, none).collect()
    assert len(got) == 32 and {r.reading_level for r in got} <= {1, 2, 3}
    assert reading.reading_levels(df.limit(0), none).count() == 0


def test_words():
    assert reading.prose_words("A `code` cat.\n```\nx\n```\n    indented code\nint y;\nThe end") == ["a", "cat", "the", "end"]


def test_cut():
    v = np.array([0.0, 1.0, 2.0, 3.0])
    assert reading.best_cut(v, np.array([1.0, 1, 0, 0]), np.array([0.0, 0, 1, 1])) == 1.5
    assert reading.best_cut(v, np.array([5.0, 1, 0, 1]), np.array([0.0, 1, 4, 4])) == 1.5
    assert reading.best_cut(v, np.zeros(4), np.array([0.0, 0, 1, 0])) < 2.0
