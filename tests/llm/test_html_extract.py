import html
import re
import time

from staylens.llm import html_extract as h

from .conftest import plain

MODEL = None


def model():
    global MODEL
    if MODEL is None:
        counts = h.Counter()
        for page in h.labelled_pages():
            h.count_page(h.Page(page), counts)
        MODEL = h.Model(counts)
    return MODEL


S = "This is a sentence, with words and a stop. "


def test_layouts_without_semantic_markup():
    page = (f"<body><div class='top-bar'><a href=/>Home</a> <a href=/a>About</a></div><div id='content'><h1>My&nbsp;title</h1>"
            f"<p>{S * 3}</p><div class='ad-slot'>Buy now! {S}</div><p>One<br>two\n three</p><ul><li>Point &amp; more</li></ul></div>"
            f"<div class='sidebar'><h3>Related</h3><p>{S}</p></div><div id='comments'><p>{S * 2}</p></div>"
            f"<div class='cookie-notice'>We use cookies. {S}</div><script>if (a<b) '</p>'</script></body>")
    assert model().extract(page) == f"My title\n\n{(S * 3).strip()}\n\nOne two three\n\nPoint & more"


def test_article_without_its_noise():
    page = (f"<header><h1>Site</h1></header><nav><p>{S}</p></nav><main><article><h1>Title</h1><p>{S}<a href=x>link</a> and"
            f" <span class=ad>AD</span> more.</p><form><label>Name</label></form><section class=comments><h2>Comments</h2>"
            f"<div class=comment><p>{S}</p></div></section><aside>{S}</aside></article></main><footer>&copy;</footer>")
    assert model().extract(page) == f"Title\n\n{S}link and more."


def test_bare_and_broken_pages():
    assert model().extract(f"<p>{S}<p>{S}") == f"{S.strip()}\n\n{S.strip()}"
    assert model().extract("") == "" and model().extract("<!-- x --><![CDATA[y]]></p></div><b>") == ""
    assert model().extract("<div>" * 3000 + plain(50)) in ("", plain(50))
    assert model().extract("<script>never closed") == ""


def test_marginals_equal_enumeration():
    page = h.Page(f"<div class=content><p>{S}</p><div class=ad><a href=x>buy</a></div></div><div class=menu><p>x</p></div>")
    m, n = model(), len(page.nodes)
    local = [[sum(v) for v in zip(*map(m.shows, own))] for own in h.all_features(page)]
    total, content = 0.0, [0.0] * n
    for bits in range(1 << (n - 1)):
        labels = [0] + [bits >> k & 1 for k in range(n - 1)]
        weight = h.exp(sum(local[k][labels[k]] + m.step(page.nodes[k])[labels[page.nodes[k].parent]][labels[k]] for k in range(1, n)))
        total += weight
        for k in range(n):
            content[k] += weight * labels[k]
    assert all(abs(a / total - b) < 1e-9 for a, b in zip(content, m.marginals(page)))


def test_table_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in h.extract_pages(pages).collect()}
    for r in pages.collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", f"<article><p>{S}</p></article>", None), (2, "u", "", "x"), (2, "u", "", "x")]
    got = h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [
        (0, "u", S.strip(), len(S.strip())), (1, "", "", 0), (2, "u", "", 0), (2, "u", "", 0)]
    assert h.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_deep_and_stray_elements_are_linear():
    n = 200_000
    for page in ("<div>" * n + plain(40), ("<div>" * 1000 + "</section>" * 1000) * (n // 2000), "<p><b>" * (n // 2) + "</i>" * n,
                 "<table>" + "<tr><td>x" * (n // 2), "<ul>" * (n // 2) + "<li>y" * (n // 2)):
        began = time.monotonic()
        h.Page(page)
        model().extract(page)
        assert time.monotonic() - began < 60


def test_only_made_pages_state_labels():
    page = f"<div data-label='1' class=menu><p>{S}</p></div><article><p>{S}</p></article>"
    assert h.labels_of(h.Page(page))[1] == 1 and h.labels_of(h.Page(page, marks=False))[1] == 0
