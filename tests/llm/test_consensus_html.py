import re

from strideframe.llm import consensus_html as ch
from strideframe.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) { x("</p>") }</script></head><body class="post-template">
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="content-12" class="entry entry-77"><h1>Title &amp; more</h1><p>First   paragraph,<br>with a <b>bold <a href="/y">link</a></b>.<p>Second one&nbsp;here: 3 &lt; 4.
<div class="ad">Buy now</div><ul><li>point one<li>point two</ul><form><input name=q><label>Search</label></form><blockquote>Quoted words.</blockquote><!-- hidden --></div>
<aside>Aside</aside><section class="comments"><p>Reader says this is a long comment, longer than the article itself, on and on and on, with commas, and more commas, and more.</p></section><footer>&copy; Site</footer></body></html>"""
WANT = "Title & more\n\nFirst paragraph, with a bold link.\n\nSecond one here: 3 < 4.\n\npoint one\n\npoint two\n\nQuoted words."


def test_article_alone():
    page = ch.Page(PAGE)
    assert page.best()[0] == ">html>body.post-template>div.entry"
    assert page.text(None) == WANT


def test_truncated_and_broken_markup():
    assert ch.Page("<article><p>One. Two &am").text(None) == "One. Two &am"
    assert ch.Page("<article><p>One.</p><script>var x").text(None) == "One."
    assert ch.Page("just words, no markup").text(None) == "just words, no markup"
    assert ch.Page("<p>a</b></div><p>b").text(None) == "a\n\nb"
    assert ch.Page("<p title=don't>One.</p><p data-x='a>b'>It's two.</p>").text(None) == "One.\n\nIt's two."
    for t in ("", "<", "<<<>>>", "<a", "<!--", "</", "<p", "<div class='x"):
        ch.Page(t).text(None)


def test_host_consensus_wins_over_a_page_of_its_own(spark):
    usual = "<body><div class='teaser'><p>{a}</p></div><div class='main-{n}'><p>Body text {n}, with commas, and a good length of prose to score well.</p></div></body>"
    rows = [(n, f"https://h.example/{n}", usual.format(a="Short.", n=n)) for n in range(5)]
    rows.append((9, "https://h.example:80/9", usual.format(a="A teaser that is, for once, much longer than the body, with many, many commas, and no end, so it would win alone, certainly so.", n=9)))
    rows.append((10, "https://other.example/", "<body><p>Elsewhere.</p></body>"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ch.extract(docs).collect()}
    assert got[9] == "Body text 9, with commas, and a good length of prose to score well." and got[10] == "Elsewhere."


def test_generated_pages_give_their_article(spark):
    sf = "/root/testdata/sf0.001"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op7_consensus_html"](spark, sf).collect()}
    assert got.keys() == source.keys()
    import html
    for k, h in source.items():
        body = h[h.index("<article>"):].split("</article>")[0]
        want = [" ".join(html.unescape(re.sub(r"<br>|<[^>]*>", " " if False else "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|article)>", body)]
        assert got[k].text == "\n\n".join(x for x in want if x) and got[k].n_chars == len(got[k].text)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "https://a.example/", "<p>x, y.</p>"), (2, "not a url", ""), (2, "not a url", ""), (3, "https://a.example", "<p>" + "word, " * 200_000 + "</p>"), (4, "https://a.example", "<nav>only menu</nav>")]
    docs = spark.createDataFrame([(*r, "p", "h", 1) for r in rows], "page_id long, url string, html string, path string, host string, n_chars int")
    got = {(r.page_id, r.n_chars) for r in ch.extract(docs).collect()}
    assert got == {(1, 0), (None, 5), (2, 0), (3, 6 * 200_000 - 1), (4, 0)}
    assert ch.extract(docs.limit(0)).count() == 0


PROSE = "<p>A paragraph of the article, with commas, and a good length.</p><p>A second one, which ends here.</p>"
PROSE_TEXT = "A paragraph of the article, with commas, and a good length.\n\nA second one, which ends here."
COMMENTS = "<ol class='comment-list'><li><article class='comment-body'><p>" + "A reader writes much, on and on, with commas, and more. " * 9 + "</p></article></ol>"


def test_layout_classes_around_the_article_drop_nothing():
    for wrapper in ("overflow-hidden", "content-sidebar-wrap", "layout has-sidebar", "fixed-header", "sidebar", "hidden", "site-header", "sidebar-left", "side-by-side", "form-group"):
        for inner in (f"<article>{PROSE}</article>", f"<main>{PROSE}</main>", f"<div role=main>{PROSE}</div>", f"<div>{PROSE}</div>"):
            for rest in ("", "<div class='sidebar'><p>Aside.</p></div>", COMMENTS):
                assert ch.Page(f"<body><div class='{wrapper}'>{inner}{rest}</div></body>").text(None) == PROSE_TEXT, (wrapper, inner, rest)
    assert ch.Page(f"<div class=comments>{PROSE}</div>").text(None) == PROSE_TEXT


def test_anchors_headings_and_code_are_kept():
    page = "<article><h2 id='search-algorithms'>Search</h2><p>One, two.</p><section id='side-effects'><h2 id=search class=header>Side effects</h2><p>Three.</p></section><section id='related'><p>Four.</p></section><pre><code>x <span class='token comment'># why</span></code></pre></article>"
    assert ch.Page(page).text(None) == "Search\n\nOne, two.\n\nSide effects\n\nThree.\n\nFour.\n\nx # why"


def test_marked_parts_still_go():
    for mark in ("class='ad'", "class='site-footer'", "class='related-posts x'", "class=post-comments", "id=sidebar", "class='cookie-notice'", "class=mainNav", "class='share-buttons'", "id='newsletter-signup'"):
        assert ch.Page(f"<body><div class=entry>{PROSE}<div {mark}><p>Beside it.</p></div></div></body>").text(None) == PROSE_TEXT, mark
    assert ch.Page("<div class='cookie-notice'><p>We use cookies.</p></div>").text(None) == ""


def test_attributes_are_names_not_words_in_values():
    page = """<div><p>The <a href="/hidden-lake">Hidden Lake</a>, seen <a href="page?id=search">here</a>.</p><p title="a hidden gem">A gem.</p><p data-role="form" data-style='display:none' data-hidden=1>Kept.</p>
<p href="/identity" id=sidebar>Gone.</p><p title='x'hidden>Gone.</p><p HIDDEN = "">Gone.</p><p a = b style = "color:red; display : none">Gone.</p><p aria-hidden=true>Gone.</p></div>"""
    assert ch.Page(page).text(None) == "The Hidden Lake, seen here.\n\nA gem.\n\nKept."


def test_headline_lead_and_siblings_of_the_best_container_stay():
    inner = f"<div class=content>{PROSE}</div>"
    for around in ("article", "div class=post"):
        page = f"<body><div class=teaser><p>Beside it.</p></div><{around}><h1>The title</h1><p>Lead.</p>{inner}<ul><li>After</ul></{around.split()[0]}></body>"
        assert ch.Page(page).text(None) == f"The title\n\nLead.\n\n{PROSE_TEXT}\n\nAfter", around
    # another container beside it, or links, are no part of it
    assert ch.Page(f"<body><div class=page><div class=teaser><p>Beside it.</p></div>{inner}</div></body>").text(None) == PROSE_TEXT
    assert ch.Page(f"<body><div class=page><p><a href=/x>Start page</a></p>{inner}</div></body>").text(None) == PROSE_TEXT


def test_a_slash_at_the_end_of_a_tag_closes_nothing():
    assert ch.Page(f"<div class=content><p>See <a href=http://x/>there</a>, and go on.</p>{PROSE}<div/>And <svg/>more.</div></div>").text(None) == f"See there, and go on.\n\n{PROSE_TEXT}\n\nAnd more."


def test_many_hosts_are_joined_like_few(spark, monkeypatch):
    rows = [(n, f"https://h{n % 40 if n % 3 else 0}.example/{n}", f"<body><div class='m{'ab'[n % 2]}'><p>Text {n}, with commas, and a length.</p></div><div class=other><p>{'x ' * (n % 50)}</p></div></body>") for n in range(300)]
    docs = spark.createDataFrame([*rows, (None, None, None), (7, "no url", "<p>x</p>")], "page_id long, url string, html string")
    want = sorted(map(str, ch.extract(docs).collect()))
    monkeypatch.setattr(ch, "BROADCAST_BYTES", 0)
    for share in (1, 5, 1000):
        monkeypatch.setattr(ch, "LARGE_SHARE", share)
        assert sorted(map(str, ch.extract(docs).collect())) == want
