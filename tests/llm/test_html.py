import numpy as np

from cohortdeck.llm.html import main_texts, repeated, text_blocks

PAGES = "page_id bigint, url string, html string, host string, texts string, part int"


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], PAGES)
    return {r.page_id: r.text for r in main_texts(df, **options).collect()}


def test_article_only(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/x>y">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad box">Buy</div>
    <article><header><h1>Title &amp; more</h1></header><p><b>Bold</b>ed text<br>next&nbsp;line<p>second&#33; a &lt; b &&& c
    <div class="share">Share me</div><form><p>Name</p></form><section id="comments"><p>First!</p></section><p>last &copy</article>
    <aside>Side</aside><footer>Foot</footer>"""
    want = "Title & more Bolded text next line second! a < b &&& c last ©"
    assert run(spark, [(1, "http://a.b/c", page)]) == {1: want}


def test_unmarked_pages_lose_what_the_host_repeats(spark):
    menu = " ".join(f"menu{k}" for k in range(12))
    rows = [
        (k, f"https://Host.example/{k}", f"<div>{menu}</div><div>own words of page{k} number{k} one{k} two{k}</div><p>end{k}</p><div>{menu}</div>")
        for k in range(5)
    ]
    rows.append((9, "https://other.example/", f"<div>{menu}</div><p>other</p>"))
    found = run(spark, rows)
    assert found[3] == "own words of page3 number3 one3 two3 end3"
    assert found[9] == f"{menu} other"


def test_same_article_on_two_pages_stays(spark):
    page = "<main><p>" + " ".join(f"word{k}" for k in range(40)) + "</p></main>"
    found = run(spark, [(1, "http://h/1", page), (2, "http://h/2", page)])
    assert found[1] == found[2] == " ".join(f"word{k}" for k in range(40))


def test_large_hosts_are_dealt_into_parts(spark):
    menu = " ".join(f"menu{k}" for k in range(12))
    rows = [(k, "http://big/" + str(k), f"<div>{menu}</div><p>only here {k * 7919}</p>") for k in range(400)]
    found = run(spark, rows, part_chars=8000)
    assert found == {k: f"only here {k * 7919}" for k in range(400)}


def test_runs_on_two_pages_of_a_large_host_go(spark):
    rows = []
    for k in range(200):
        shared = " ".join(f"pair{k // 2}w{i}" for i in range(12))
        rows.append((k, f"http://big/{k}", f"<p>{shared}</p><p>only here {k * 7919}</p>"))
    want = {k: f"only here {k * 7919}" for k in range(200)}
    assert run(spark, rows) == want
    assert run(spark, rows, part_chars=2000) == want


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>plain</p>"), (None, "http://h/", "<article>x"), (4, "http://h/", "text < b > c <"), (4, "http://h/", "text < b > c <")]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], PAGES)
    found = sorted((tuple(r) for r in main_texts(df).collect()), key=str)
    assert found == sorted([(1, None, ""), (2, "", ""), (3, "no url", "plain"), (None, "http://h/", "x")] + [(4, "http://h/", "text < b > c <")] * 2, key=str)
    assert main_texts(df.filter("page_id > 99")).collect() == []


def test_long_page():
    page = "<article>" + "".join(f"<p>word{k} &amp;</p>" for k in range(30000))
    assert len(text_blocks(page)) == 30000
    assert text_blocks("<div" * 20000) != []


def test_suffix_array_covers_what_windows_do():
    rng = np.random.default_rng(2)
    for least in (1, 2, 3, 5, 8):
        tokens = rng.integers(0, 3, 300)
        pages = np.repeat(np.arange(6), 50)
        tokens[49::50] = -1 - np.arange(6)
        where = {}
        for k in range(300 - least + 1):
            where.setdefault(tuple(tokens[k : k + least]), []).append(k)
        want = np.zeros(300, bool)
        for places in where.values():
            if len({pages[k] for k in places}) > 1:
                for k in places:
                    want[k : k + least] = True
        assert (repeated(tokens, pages, least) == want).all()
