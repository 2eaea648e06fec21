from stratachain.llm.op1_extract import MAIN, OPEN, blocks, extract, repeated_runs


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header>Site</header><nav><ul><li>Home</ul></nav><!-- x --><div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header><p><b>One <i>t</i>wo<br>three
    <p>four&nbsp;five</p><div id="comments"><p>nice!</p></div></article><aside>more</aside><footer>&copy;</footer>"""
    assert [t for r, t in blocks(page) if r == MAIN] == ["A & B", "One two", "three", "four five"]
    assert [t for r, t in blocks(page) if r == OPEN] == []


def test_odd_markup():
    assert blocks("") == []
    assert blocks("a < b <p>c") == [(OPEN, "a < b"), (OPEN, "c")]
    assert blocks('<p title="x>y">z</p><script>never ends') == [(OPEN, "z")]


def test_repeated_runs_against_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(20):
        base = [rng.choice("abcd") for _ in range(40)]
        streams = [base[(i := rng.randrange(30)) : i + rng.randrange(15)] + [rng.choice("abcdefgh") for _ in range(rng.randrange(10))] for _ in range(6)]
        got = repeated_runs(streams, 4)
        for k, s in enumerate(streams):
            want = [False] * len(s)
            for i in range(len(s) - 3):
                if any(s[i : i + 4] == t[j : j + 4] for m, t in enumerate(streams) if m != k for j in range(len(t) - 3)):
                    want[i : i + 4] = [True] * 4
            assert got[k].tolist() == want


def test_host_boilerplate_goes_where_no_article_is(spark):
    notice = "<div>this site uses many small files to remember who you are today</div>"
    rows = [(i, f"http://h.example/{i}", f"{notice}<p>page number {i} tells story {i * 7} of its own</p>", "x") for i in range(3)]
    rows += [(9, "http://h.example/9", None, "x"), (10, None, "<p>alone</p>", "x"), (9, "http://h.example/9", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text, r.n_chars) for r in extract(pages).collect()}
    assert got == {(i, t := f"page number {i} tells story {i * 7} of its own", len(t)) for i in range(3)} | {(9, "", 0), (10, "alone", 5)}
    assert extract(pages).count() == 6
    assert extract(pages.limit(0)).count() == 0


def test_host_boilerplate_goes_however_pages_are_dealt(spark):
    notice = "<div>this site uses many small files to remember who you are today</div>"
    menu = "<div>start shop news press jobs contact terms imprint</div>"
    body = lambda i: f"<p>page number {i} tells story {i * 7} of its own</p>"
    rows = [(i, f"http://h.example/{i}", (notice if i in (3, 17) else "") + body(i) + (menu if i % 6 == 0 else "")) for i in range(24)]
    rows += [(3, "http://h.example/3", notice + body(3)), (30, "http://h.example/30", "<p>a text of eight words that comes twice here</p>"), (30, "http://h.example/30", "<p>a text of eight words that comes twice here</p>")]
    rows += [(40 + i, f"http://other.example/{i}", notice + body(40 + i)) for i in range(1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(tuple(r) for r in extract(pages).collect())
    assert {t for i, _, t, _ in want if i < 30} == {f"page number {i} tells story {i * 7} of its own" for i in range(24)}
    assert [t for i, _, t, _ in want if i == 30] == ["a text of eight words that comes twice here"] * 2
    assert [t for i, _, t, _ in want if i == 40] == [f"this site uses many small files to remember who you are today page number 40 tells story {40 * 7} of its own"]
    for most in (1, 2, 5):
        assert sorted(tuple(r) for r in extract(pages, most=most).collect()) == want
