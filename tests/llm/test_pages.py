from tramline.llm.pages import Page, extract_main_text

PAGE = '<html><head><title>t</title></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>Head {i}</h1><p>A &amp; {i}<br>b\n c <b>bo</b>ld<p>Second {i}</p></article><div id="comments">no</div><footer>f</footer></body></html>'


def test_main_text(spark):
    pages = [(i, "http://a.example/x", PAGE.format(i=i), "extra") for i in range(6)] + [(6, None, None, "e"), (7, "u", "", "e"), (8, "http://b.example", PAGE.format(i=8), "e"), (8, "http://b.example", PAGE.format(i=8), "e")]
    out = extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(pages)
    for r in out:
        i = r["page_id"]
        assert r["text"] == ("" if i in (6, 7) else f"Head {i} A & {i} b c bold Second {i}")


def test_empty_table(spark):
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_markup():
    assert Page('<p>a<script>var t="</p>";</script>b</div><nav>x').main_text([], set()) == "a b"


def test_constant_blocks_by_place(spark):
    """A heading of all articles stays on large hosts as on small ones; a line beside the slot goes where a page lacks the slot."""
    page = "<html><body><div class='top'>Line of the site</div>{}</body></html>"
    for n in (4, 12):
        rows = [(i, "http://a.example/x", page.format(f"<article><div class='t'><h2>Standing head</h2><p>Own text {i} of some length</p></div></article>")) for i in range(n)]
        rows.append((n, "http://a.example/x", page.format("<section>Elsewhere</section>")))
        out = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows[:n], "page_id long, url string, html string")).collect()}
        assert out == {i: f"Standing head Own text {i} of some length" for i in range(n)}
        out = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert out[n] == "Elsewhere"
