"""Main text extraction: hand-made pages, then a brute-force reading of the article element."""

from __future__ import annotations

import html
import re

import pytest

from sylvatica.llm import html_text

TREE = html_text.train()

PAGES = {
    "plain": ("<html><body><article><p>One  two\n three</p><p>Four</p></article></body></html>", "One two three Four"),
    "references": ("<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&#xe9; &nbsp; d</p></article>", "a & b <c> ééé d"),
    "twice_encoded": ("<article><p>&amp;amp; &amp;lt;b&amp;gt;</p></article>", "&amp; &lt;b&gt;"),
    "inline": ("<article><p>un<b>bro</b>ken <a href=x>li</a>nk</p></article>", "unbroken link"),
    "unclosed": ("<article><h1>Title</h1><p><b>Title<br><p>Body of it</p></article>", "Title Title Body of it"),
    "furniture": (
        "<body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies on this site, please accept all of them now.</div>"
        "<div class=\"ad\">Buy this now and never regret it again my friend.</div>"
        "<main><article><h1>Head</h1><p>The body text stands here and is long enough.</p><p>Short.</p></article>"
        "<section id=comments><h2>Comments</h2><p>Reader says this is a very nice article indeed.</p></section></main>"
        "<aside><p>A long side story that has nothing to do with the article at all.</p></aside>"
        "<form><label>Mail</label><input name=q><button>Go</button></form><footer>&copy; 2024 Site</footer></body>",
        "Head The body text stands here and is long enough. Short.",
    ),
    "scripts": ("<head><title>T</title><script>var a='</p>';</script></head><body><script>x<y</script><style>p{}</style><noscript>no</noscript><article><p>Yes</p><!-- <p>no</p> --></article>", "Yes"),
    "cut": ("<article><p>Goes on and on", "Goes on and on"),
    "cut_in_tag": ("<article><p>Goes on</p><p class='x", "Goes on"),
    "cut_script": ("<article><p>Goes on</p><script>var x = '<p>no</p>", "Goes on"),
    "no_article": (
        "<body><ul><li><a href=/>Home</a></li><li><a href=/x>About us</a></li></ul><h1>A heading for the page</h1>"
        "<div>Running text of a page that has no article element but is clearly its main content, as it is long.</div>"
        "<div>More running text of the same page, which goes on for a while and then ends.</div><div class=footer>Imprint</div></body>",
        "A heading for the page Running text of a page that has no article element but is clearly its main content, as it is long. "
        "More running text of the same page, which goes on for a while and then ends.",
    ),
    "link_paragraph": ("<article><p>Before it comes a paragraph of plain words.</p><p><a href=x>only a link</a></p><p>And plain words come after it.</p></article>",
                       "Before it comes a paragraph of plain words. only a link And plain words come after it."),
    "link_list": ("<article><p>Before it comes a paragraph of plain words.</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>",
                  "Before it comes a paragraph of plain words. one two three"),
    "hyphenated": ("<article><div class='post ad-free'><p>First text</p></div><section class='social-science'><p>Second text</p></section><div id='share-prices'>Third</div><div class='search-history'>Fourth</div>"
                   "<div class='shareButtons'>Send this</div><div id=ad_slot_2>Buy</div><ul class='related-posts'><li>More</ul></article>", "First text Second text Third Fourth"),
    "short_page": ("<body><div class=menu><a href=/>Home</a></div><h1>A title</h1><div>Short.</div><div>Also short</div></body>", "A title Short. Also short"),
    "menu_without_marks": ("<body><div><a href=/>Home</a></div><div>Topics</div><div><a href=/a>Wood</a></div><div><a href=/b>Stone</a></div><p>The text of the page, which runs over more than a few words.</p>"
                           "<p><a href=/s>The whole study</a></p><p>It goes on after a link that stands alone between two of its parts.</p><div><a href=/c>Next</a></div><div><a href=/d>Last</a></div></body>",
                           "The text of the page, which runs over more than a few words. The whole study It goes on after a link that stands alone between two of its parts."),
    "list": ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one two a b"),
    "hidden": ("<article><p>Seen</p><p hidden>Unseen</p><div style='display: none'>Unseen</div></article>", "Seen"),
    "custom_elements": (
        "<article><svg-icon name=x></svg-icon><p>First part of it</p><template-part>Second</template-part><title-bar></title-bar><p>Third part of it</p></article>",
        "First part of it Second Third part of it",
    ),
    "self_closed": ("<article><p>Before the drawing</p><svg viewBox='0 0 1 1' data-x='a>b'/><p>After the drawing</p><math/><p>End</p></article>", "Before the drawing After the drawing End"),
    "closed_drawing": ("<article><p>Before it</p><svg><text>no</text></svg><p>After it</p></article>", "Before it After it"),
    "unclosed_drawing": ("<article><p>Before it</p><svg><path d='x'><p>After it all</p></article>", "Before it After it all"),
    "article_class": ("<article class='post has-comments related-tags'><p>Text of the post</p></article>", "Text of the post"),
    "main_class": ("<main class='has-comments no-sidebar'><p>Text of the main part of it</p></main>", "Text of the main part of it"),
    "body_class": ("<html class=no-menu><body class='page no-sidebar newsletter'><p>Text of a page that has no article element, which is quite long enough.</p></body></html>",
                   "Text of a page that has no article element, which is quite long enough."),
    "section_class": ("<article><section class='with-sidebar'><p>Text of the section</p></section><div class='menu-open'><p>More text of it</p></div></article>", "Text of the section More text of it"),
    "comment_articles": ("<article><p>The story itself</p></article><div class=comment-list><article class=comment-body><p>A reader says so</p></article></div><article class='comment'><p>Another reader</p></article>", "The story itself"),
    "empty": ("", ""),
    "markup_only": ("<html><body></body></html>", ""),
    "stray": ("<article></p><p>a < b and c > d</p></div></article>", "a < b and c > d"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, expected = PAGES[name]
    assert html_text.main_text(page, TREE) == expected


def test_tree_fits_its_table():
    assert ((TREE.predict(html_text.LABELLED[:, :-1]) >= 0.5) == html_text.LABELLED[:, -1]).all()
    used = {html_text.NAMES[f] for f in TREE.feature if f >= 0}
    assert {"words", "density", "words_before", "density_before", "words_after", "density_after"} <= used


def plain_reading(page):
    """What the driver's pages hold beside scripts, menu, advert and footer, whatever element their text stands in."""
    body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<(script|style|nav|footer)\b.*?</\1>|<div class=\"ad\">.*?</div>", " ", page)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1|div|section)\b[^>]*>", " ", body))).split())


@pytest.mark.parametrize("hidden", [None, "div", "section", 'div class="post"'])
def test_against_a_plain_reading_with_the_article_hidden(sf_dir, hidden):
    import duckdb

    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{sf_dir}/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    for page in pages:
        if hidden:
            page = page.replace("<article>", f"<{hidden}>").replace("</article>", f"</{hidden.split()[0]}>")
        assert html_text.main_text(page, TREE) == plain_reading(page)


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "<article><p>a</p></article>", "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<p>" + "word " * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {(r.page_id, r.n_chars) for r in html_text.extract(pages).collect()}
    assert found == {(1, 0), (None, 1), (2, 0), (3, 999_999)}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_against_article_element(spark, sf_dir):
    """On the driver's pages the content is the article element: read it by other means."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.html for r in pages.collect()}
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(texts)
    for row in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", texts[row.page_id], re.S)[1]
        spaced = re.sub(r"</?(?:p|br|h1)>", " ", inner)
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", "", spaced)).split())
        assert (row.text, row.n_chars) == (expected, len(expected))


def test_time_does_not_grow_with_depth():
    import time

    def took(n):
        page = "<article>" + "".join(f"<div><p>text {i}<span>" for i in range(n))
        began = time.process_time()
        assert len(html_text.blocks(page)) == n
        return time.process_time() - began

    took(200)
    assert took(8000) < 12 * max(took(2000), 0.02)
