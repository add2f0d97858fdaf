"""HTML extraction: against plain recursion over generated trees, on broken and very deep pages, and by hosts."""

import random
import time
import tracemalloc
from html import escape

import pytest

from plumbline.llm import html_extract


def _phrase(rng, n):
    return " ".join(rng.choice(["word", "ärger", "a&b", "x<y", "日本", "tail", "more", "thing"]) for _ in range(n))


def _article(rng, depth, blocks):
    """Markup of random nested elements; the blocks of text that it holds are added to `blocks`."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if depth and kind < 0.3:
            tag = rng.choice(["div", "section", "blockquote", "header", "div class='part-7'"])
            out.append(f"<{tag}>{_article(rng, depth - 1, blocks)}</{tag.split()[0]}>")
        elif kind < 0.4:
            items = [_phrase(rng, 3) for _ in range(rng.randint(1, 3))]
            blocks += items
            out.append("<ul>" + "".join(f"<li>{escape(i)}" + ("</li>" if rng.random() < 0.5 else "") for i in items) + "</ul>")
        elif kind < 0.5:
            out.append(rng.choice(["<form><p>send</p></form>", "<div class='comments'><p>I say</p></div>", "<aside>by the way</aside>", "<script>if (a<b) '</p>'</script>", "<!-- <p>no</p> -->", "<style>p{}</style>", "<footer>tags</footer>"]))
        elif kind < 0.6:
            title = _phrase(rng, 2)
            blocks.append(title)
            out.append(f"<h2 class='related'>{escape(title)}</h2>")
        else:
            words = [_phrase(rng, 4) for _ in range(rng.randint(1, 3))]
            blocks.append(" ".join(words))
            out.append("<p>" + rng.choice(["<br>", " ", "\n\t"]).join(f"<b>{escape(w)}</b>" if rng.random() < 0.3 else escape(w) for w in words) + ("</p>" if rng.random() < 0.6 else ""))
    return "".join(out)


def _page(rng):
    blocks = []
    inner = _article(rng, 3, blocks) + f"<p>{'long closing words of the article ' * 8}</p>"
    blocks.append(("long closing words of the article " * 8).strip())
    around = "<header class='site-header'><p>Site</p></header><nav><ul><li><a href='/'>home</a></ul></nav><div class='ad'>buy</div>"
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{around}<article>{inner}</article><footer>&copy; us</footer></body></html>"
    return page, "\n".join(blocks)


def test_generated_pages_match_plain_recursion(spark):
    rng = random.Random(5)
    made = [_page(rng) for _ in range(150)]
    rows = [(i, [f"http://h{i % 7}.org/{i}", None, "nothing"][i % 3], html, "x", "y") for i, (html, _) in enumerate(made)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, best string").repartition(4)
    got = {r.page_id: r.text for r in html_extract.extract_main_text(frame).collect()}
    for i, (_, text) in enumerate(made):
        assert got[i] == text, made[i][0]
    shuffled = {r.page_id: r.text for r in html_extract.extract_main_text(frame, broadcast_hosts=-1).collect()}
    assert shuffled == got


MEGABYTE = 1 << 20


@pytest.mark.parametrize(
    "unit",
    ["<div>", "<div class='content'>", "<a ", "<p><button><div>", "<svg>", "<!", "<", "<a \"", "<a '>\"", "<li>", "<div><li>x", "<b>t", "<tr><td>x", "<h1>", "&amp", "<!--", "<![CDATA[", "</div>", "<a" + "b" * 50, "class=\"", "<p class='", "</p", "<ul><li>"],
)
def test_a_megabyte_of_anything_takes_seconds(unit):
    for source in (unit * (MEGABYTE // len(unit)), "<body><p>text</p>" + unit * (MEGABYTE // len(unit)) + ">"):
        began = time.time()
        page = html_extract.Page(source)
        page.best(), page.ends()
        assert time.time() - began < 10


def test_a_deep_page_takes_bounded_memory():
    tracemalloc.start()
    page = html_extract.Page("<div class='content'>" * 20_000 + "deep text")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert page.texts == ["deep text"] and page.inside == [20_000] and peak < 60 << 20


def test_a_template_of_the_host_keeps_its_own_path(spark):
    main = "<div class='wrap'><div class='story'><p>{0}</p></div><div class='teaser'>{1}</div></div>"
    long, short = "the text of the page goes on " * 9, "a teaser"
    rows = [(i, f"http://c.org/{i}", main.format(long, short)) for i in range(10)]
    rows += [(20 + i, f"http://c.org/x{i}", "<div class='wrap'><div class='gallery'><p>" + long + f"</p></div><div class='story'>{short}</div></div>") for i in range(2)]
    rows += [(30, "http://c.org/y", "<div class='wrap'><div class='odd'><p>" + long + f"</p></div><div class='story'>{short}</div></div>")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[20] == got[21] == got[30] == long.strip()


ARTICLE = [f"Paragraph {i} of the article with some words in it, quite a few of them." for i in range(6)]
MARKUP = "".join(f"<p>{t}</p>" for t in ARTICLE)


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='sidebar-layout'><div class='content'>{0}</div></div></body>",
        "<body><div class='comments-open'><article>{0}</article></div></body>",
        "<body><div id='subscribe'>{0}</div><div class='ad'>buy</div></body>",
        "<body class='has-sidebar'><div class='login-page modal'><main>{0}</main><div class='sidebar'>aside words</div></div></body>",
        "<div class='promo'><div class='widget'>{0}</div></div><div class='site-notice'>we use cookies</div>",
        "<article>{0}</article><ol class='comment-list'><li><article class='comment-body'>" + "I say a lot. " * 99 + "</article></ol>",
        "<article>{0}<div class='comments'><p>" + "I say. " * 999 + "</p></div></article>",
        "<article>{0}<div class='social-share'><a href='x'>tweet it</a> <a href='y'>post it</a></div><div class='notice'>moved</div></article>",
    ],
)
def test_a_name_alone_empties_no_page(page):
    assert html_extract.Page(page.format(MARKUP)).texts == ARTICLE


def test_names_inside_an_article_and_formulas():
    inner = "<p class='market-share'>a</p><div class='job-search'>b</div><div class='story-widget'>c</div><p class='alert'>d</p><p><math><mi>x</mi></math> <label>l</label></p>"
    page = html_extract.Page(f"<article>{MARKUP}{inner}<p>e <span class='ad-label'>advert</span> f</p></article>")
    assert page.texts == [*ARTICLE, "a", "b", "c", "d", "x l", "e f"]


def test_a_teaser_in_the_hosts_path_is_not_the_article(spark):
    long = "the text of the page goes on " * 9
    rows = [(i, f"http://t.org/{i}", f"<body><main class='story'><p>{long}</p></main><div class='content'><p>more</p></div></body>") for i in range(10)]
    rows += [(10, "http://t.org/x", f"<body><main class='story'><p>Teaser: see more.</p></main><div class='content'><p>{long}</p></div></body>")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {long.strip()}


def test_votes_of_hosts_with_several_templates(spark):
    """Random wrappers and templates: paths, votes and choices counted again in plain Python."""
    rng = random.Random(9)
    wrappers, templates = ["page", "sidebar-layout", "comments-open", "wrap-3", "subscribe"], ["story", "content", "gallery", "text-body"]
    rows, want = [], {}
    for i in range(300):
        host, text = f"h{rng.randrange(6)}.net", " ".join(_phrase(rng, 9) for _ in range(rng.choice([1, 2, 9])))
        shape = rng.choices(templates, [12, 4, 2, 1])[0]
        side = f"<div class='{rng.choice(templates)}-side'>{_phrase(rng, 3)}</div>" if rng.random() < 0.5 else ""
        rows.append((i, f"https://{host}/{i}", f"<body><div class='{rng.choice(wrappers)}'><div class='{shape}'><p>{escape(text)}</p><p>{escape(_phrase(rng, 5))}</p></div>{escape(side) and side}</div></body>"))
    pages = {i: html_extract.Page(html) for i, _, html in rows}
    votes = {}
    for i, url, _ in rows:
        page = pages[i]
        best = page.best()
        own = votes.setdefault(url.split("/")[2], {})
        own.setdefault((page.paths[best], page.depths[best]), []).append(i)

    def inside(page, path):
        above = lambda c: [] if c < 0 else [page.paths[c], *above(page.parents[c])]
        return "\n".join(t for t, c in zip(page.texts, page.inside, strict=True) if path in above(c))

    for i, url, _ in rows:
        own, page = votes[url.split("/")[2]], pages[i]
        winner = min(own, key=lambda k: (-len(own[k]), k[1], k[0]))[0]
        kept = {k[0] for k, v in own.items() if len(v) > 1 and len(v) * 10 >= sum(map(len, own.values()))}
        best = page.paths[page.best()]
        mine, theirs = inside(page, best), inside(page, winner)
        enough = theirs and len(theirs) * (4 if theirs in mine else 2) >= len(mine)
        want[i] = theirs if best not in kept and enough else mine
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in html_extract.extract_main_text(frame).collect()} == want
