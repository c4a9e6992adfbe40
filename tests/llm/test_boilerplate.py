from millrace.llm import boilerplate

SCHEMA = "page_id long, url string, title string, main_content string, site string, element long, shapes string"
WORDS = "amber birch cedar delta ember flint grove heath islet jetty knoll larch".split()


def code(k):
    return f"int {WORDS[k]}(int a) {{\n    if (a) {{\n        return {WORDS[-k]};\n    }}\n    return 0;\n}}"


def page(i, site, body, title="A page about things"):
    text = f"Menu\nHome\nDocs\nHome › Docs › {title[:20]}\n\n{title}\n{body}\nTrending\n→ Some other page\nFourth page here (12)\nPowered by sitepress\n© 2024 {site.title()}Corp. All rights reserved.\nWe use cookies to improve your visit."
    return (i, f"https://{site}.example/p/{i}", f"{title} - {site.title()}Corp", text)


def rows():
    out = []
    for k in range(12):
        out.append(page(k, "alpha", f"The {WORDS[k]} speaks of {WORDS[-k]}. It goes on.\nHome is where {WORDS[k]} starts.\n{code(k)}", f"Title of {WORDS[k]} page"))
    for k in range(10):
        out.append(page(100 + k, "beta", f"Another {WORDS[k]} says that this holds.\nSecond line of {WORDS[-k]} follows.", f"Beta page about {WORDS[k]}"))
    out.append(page(500, "lonely", "A single page has its own sentence.\nAnd a second one.", "The lonely page title"))
    out.append((600, None, None, None))
    out.append((601, "no url", "x", ""))
    out.append((602, "https://u.example/1", None, "Menu\n\nFound title line here\nThis text stands alone on its site and is long."))
    return out


def test_only_own_lines_stay(spark):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows()], SCHEMA)
    drop: dict = {}
    for r in boilerplate.boilerplate_lines(df).collect():
        drop.setdefault(r.page_id, set()).add(r.line_no)
    for pid, _, _, text in rows():
        if not text:
            assert pid not in drop
            continue
        kept = [ln for i, ln in enumerate(text.split("\n"), 1) if ln.strip() and i not in drop.get(pid, ())]
        if pid < 100:
            assert kept == [f"Title of {WORDS[pid]} page", f"The {WORDS[pid]} speaks of {WORDS[-pid]}. It goes on.", f"Home is where {WORDS[pid]} starts.", *code(pid).split("\n")]
        elif pid < 200:
            k = pid - 100
            assert kept == [f"Beta page about {WORDS[k]}", f"Another {WORDS[k]} says that this holds.", f"Second line of {WORDS[-k]} follows."]
        elif pid == 500:
            assert kept == ["The lonely page title", "A single page has its own sentence.", "And a second one."]
        elif pid == 602:
            assert kept == ["Found title line here", "This text stands alone on its site and is long."]
    texts = {r.page_id: r.main_content for r in boilerplate.main_content(df).collect()}
    assert texts[500] == "The lonely page title\nA single page has its own sentence.\nAnd a second one."
    assert texts[600] is None and texts[601] == ""


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows()], SCHEMA)
    once = sorted(tuple(r) for r in boilerplate.boilerplate_lines(df).collect())
    assert sorted(tuple(r) for r in boilerplate.boilerplate_lines(df.unionAll(df)).collect()) == once
    assert boilerplate.boilerplate_lines(df.limit(0)).count() == 0


def test_refusals(spark):
    body = "Please sign in to continue reading."
    pages = [(k, f"https://s{k}.example/", "Some title here", f"Menu\nPage not found\n{body}\nrev 1.2.3") for k in range(6)]
    pages += [(50, "https://z.example/", "Own title", "Own title\nShort but own text.")]
    df = spark.createDataFrame([(*r, "c", 1, "c") for r in pages], SCHEMA)
    got = {tuple(r) for r in boilerplate.boilerplate_lines(df).collect()}
    assert got == {(k, n) for k in range(6) for n in (1, 2, 3, 4)}


def test_long_page(spark):
    text = "\n".join(f"Line {i} of a very long page is a sentence." for i in range(20_000))
    df = spark.createDataFrame([(1, "https://a.example/", "t", text, "c", 1, "c")], SCHEMA)
    assert boilerplate.boilerplate_lines(df).count() == 0
