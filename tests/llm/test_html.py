import html as stdlib_html
import random
import re
import time

import pytest

from tabstudy.llm import QUERIES, html


def test_whole_table_against_a_plain_cut(spark, folder):
    """In these pages the article element holds the article; cut it out and strip its tags."""
    rows = QUERIES["op3_html_text"](spark, folder).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        inner = re.sub(r"</?(?:p|h\d|br|div|li|ul)\b[^>]*>", " ", inner)
        want = " ".join(stdlib_html.unescape(re.sub(r"</?[a-z][^>]*>", "", inner)).split())
        assert (r.text, r.n_chars) == (want, len(want))


BODY = ["The first paragraph of the story is here and it is long enough to be told from the rest of the page by its words.",
        "It was the second one that had to be in the middle of all, with <a href='/x'>a link</a> in it &amp; more of the same for the reader.",
        "Short one.", "At the end of the story there is a last paragraph, which is as long as the others and has the same kind of words in it."]
WANT = " ".join(re.sub("<[^>]*>", "", b).replace("&amp;", "&") for b in BODY)
MARGINS = ["<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav>", "<header><p>The name of the site and its slogan, which is long and has of the in it for you.</p></header>",
           "<div class='sidebar'><p>Most read of the week in the region and on the site, with all of the words that it has.</p></div>", "<aside>More of the same for you to read on this site and others.</aside>",
           "<div id='cookie-notice'><p>We use cookies on this site to make it better for you and all of the others. <button>OK</button></p></div>",
           "<form action='/s'><label>Search the site for the words</label><input name=q><select><option>a<option>b</select></form>", "<div class=\"ad\">Buy the best of the new things that are in the shop for you to have.</div>",
           "<section id=comments><h3>Comments</h3><div class='comment'><p>I do not think that it is the best of the stories on this site, but it was good.</p></div></section>",
           "<footer>&copy; The site and all of its owners. All the rights are with them.</footer>", "<script>var a = '<p>the text of the script</p>';</script>", "<style>p > b {color: red}</style>", "<!-- <p>the comment</p> -->",
           "<ul class='menu'><li><a href=/1>One of the links in the menu</a><li><a href=/2>Two of the links</a></ul>"]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div>{}</div>"])
def test_margins_around_the_article(frame):
    rnd = random.Random(2)
    for _ in range(20):
        body = frame.format("".join(f"<p>{b}</p>\n" for b in BODY))
        before, after = rnd.sample(MARGINS, 4), rnd.sample(MARGINS, 4)
        page = "<!DOCTYPE html><html><head><title>A title of the page</title></head><body>" + "".join(before) + body + "".join(after) + "</body></html>"
        assert html.extract(page) == WANT, page


def test_margins_inside_the_article():
    for m in MARGINS[2:]:
        page = f"<body><article><p>{BODY[0]}</p>{m}<p>{BODY[1]}</p><p>{BODY[2]}</p><p>{BODY[3]}</p></article></body>"
        assert html.extract(page) == WANT, m


def test_blocks_inline_tags_and_references():
    assert html.extract("<article><h1>A&nbsp;&lt;b&gt;</h1><p>one<b>two</b>\n three<br>four &eacute;&#233;&#x41; &am a < b</p>tail</article>") == "A <b> onetwo three four ééA &am a < b tail"
    assert html.extract("<article><p>open <b>bold<p>next <i>it</article>") == "open bold next it"
    assert html.extract("<main><p>cut off in <a href='x") == "cut off in"


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>"), (3, "w", "plain text without any tags"), (3, "w", "<nav>only a menu</nav>"), (4, "x", "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    out = {(r.page_id, r.url): r.n_chars for r in html.main_texts(df).collect()}
    assert len(out) == 5 and out[(4, "x")] == 50_000 * 12 - 1
    assert html.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["<a " * 20_000, "<" * 100_000, "<div>" * 50_000, "<a title=\"" * 5_000, "<!--" * 20_000, "<p class='" + "x " * 50_000, "</b>" * 50_000])
def test_hostile_pages_end(bad):
    start = time.time()
    html.extract(bad)
    assert time.time() - start < 10


def test_article_elements_alone_change_nothing(spark, folder):
    pages = [r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    opened = 0
    for page in pages:
        opened += any(html.first_pass(b) == html.OPEN for b in html.blocks(page))
        assert html.extract(re.sub("(</?)article>", r"\1div>", page)) == html.extract(page)
    assert opened > len(pages) / 2
    body = "".join(f"<p>{b}</p>" for b in BODY)
    cards = "<article><h3>More news</h3><p>Read on</p></article>"
    assert html.extract(f"<body>{cards}<div>{body}</div></body>").endswith(WANT)
    box = "<main><p>It is the box of the day and of the week for all of you.</p></main>"
    assert html.extract(f"<body><div>{body}</div>{box}</body>").startswith(WANT)
    links = "<p>" + " ".join(f"<a href='/{i}'>Another story</a>" for i in range(8)) + "</p>"
    assert html.extract(f"<body><article>{body}{links}</article></body>") == WANT


def test_open_blocks_take_the_label_of_neighbours():
    block = lambda text, margin=False, heading=False: html.Block(text, 0, margin, False, heading)
    good, bad, open_ = html.GOOD, html.BAD, html.OPEN
    cases = [([good, open_, open_, open_, bad], [good, good, good, bad, bad]), ([bad, open_, good], [bad, good, good]), ([open_, bad, open_], [bad, bad, bad]), ([open_, open_], [good, good])]
    for labels, want in cases:
        assert html.second_pass([block("x")] * len(labels), labels) == want
    # headings look ahead; margin parts are nobody's neighbours
    assert html.second_pass([block("x"), block("h", heading=True), block("x")], [good, open_, bad]) == [good, bad, bad]
    assert html.second_pass([block("x"), block("y"), block("m", margin=True)], [good, open_, bad]) == [good, good, bad]
