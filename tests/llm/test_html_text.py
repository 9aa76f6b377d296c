"""Planted pages, the two passes by themselves, and whole tables against what their markup says."""

import html
import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymatch.llm import html_text

FOLDER = "/root/testdata/sf0.01"
LONG = "The storm that came over the hills in the evening was one of the worst that anyone in the valley had ever seen."
OTHER = "It was not until the next morning that the people who lived there could see what the water had done to the road."


PAGES = {
    "plain": (f"<html><body><p>{LONG}</p><p>Short.</p><p>{OTHER}</p></body></html>", f"{LONG}\nShort.\n{OTHER}"),
    "article": (
        f"<nav><a href=/>Home</a></nav><div>Top offer</div><article><h1>Title</h1><p>In.</p><p>{LONG}</article><p>{OTHER}</p>",
        f"Title\nIn.\n{LONG}",
    ),
    "short article": ("<nav>menu</nav><article><h1>A. B</h1><p><b>A.<br></article><footer>&copy; x</footer>", "A. B\nA."),
    "references": (f"<p>Caf&eacute; &amp; &#x4e2d;&lt;b&gt; {LONG}</p>", f"Café & 中<b> {LONG}"),
    "white space": (f"<p>  a\n\t b&nbsp;c<br>d   <i>e</i>f  {LONG}</p>", f"a b c d ef {LONG}"),
    "hidden parts": (
        f"<p>{LONG}</p><script>if (a < b) {{ document.write('<p>no</p>') }}</script><style>p {{}}</style>"
        f"<!-- <p>no</p> --><noscript><p>no</p></noscript><form><p>{LONG}</p></form><p>{OTHER}</p>",
        f"{LONG}\n{OTHER}",
    ),
    "set aside": (
        f'<main><p>{LONG}</p><div class="side-bar related">{OTHER}</div><aside>{OTHER}</aside><div id="commentList">{OTHER}</div>'
        f'<section class="reader-comments"><p>{OTHER}</p></section><div role="navigation">{OTHER}</div>'
        f'<div class="cookieNotice">{OTHER}</div><header>{OTHER}</header><p>{OTHER}</p></main>',
        f"{LONG}\n{OTHER}",
    ),
    "links": (
        f"<p>{LONG}</p><ul><li><a href=a>{OTHER}</a></li><li><a href=b>More</a></li></ul><p>{OTHER}</p><p><a>Next</a> page</p>",
        f"{LONG}\n{OTHER}",
    ),
    "no prose": (f"<p>{'x1 2z ' * 40}</p><p>short</p>", ""),
    "neighbours": (f"<p>{LONG}</p><p>near</p><p>{'x1 2z ' * 40}</p><p>far</p>", f"{LONG}\nnear"),
    "linked title": (f"<article><h1><a href=x>{OTHER}</a></h1><p>{LONG}</article>", f"{OTHER}\n{LONG}"),
    "list": (f"<article><p>{LONG}<ul><li>one<li>two <b>three</b></ul><table><tr><td>a<td>b<tr><td>c</table></article>",
             f"{LONG}\none\ntwo three\na\nb\nc"),
    "no tags": (LONG, LONG),
    "broken": (f"<p>{LONG}</b></div><p <p>{OTHER}<", f"{LONG}\n{OTHER}<"),
    "empty": ("", ""),
    "open script": (f"<p>{LONG}</p><script>var t = '<p>no", LONG),
    "head": (f"<head><title>T</title><meta charset=x></head><body class='menu-open'><p>{LONG}</p></body>", LONG),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert html_text.main_text(page) == text


def test_passes():
    yes, no = True, False
    assert html_text.second_pass([None, yes, None, None, no, None], False) == [yes, yes, yes, no, no, no]
    assert html_text.second_pass([no, None, yes, None, no], False) == [no, yes, yes, yes, no]
    assert html_text.second_pass([None, None], True) == [True, True]
    assert html_text.first_pass(html_text.Block(0, text=LONG)) is True
    assert html_text.first_pass(html_text.Block(0, text="short")) is None
    assert html_text.first_pass(html_text.Block(0, linked=100, text=LONG)) is False


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a>", "</a>", "<", ">", "&amp", "<!--", "-->", "<li>", "<td>", "</table>",
                                 "<table>", "<script>", "</script>", "<article>", "</article>", "x ", "é\n", "<body>", "<head>", "<br/>", "'", '"', "="]), max_size=40))
def test_any_markup(parts):
    text = html_text.main_text("".join(parts))
    assert text == "\n".join(re.sub(r"\s+", " ", line).strip() for line in text.split("\n") if line.strip() or not text)


def test_given_tables(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    found = {r.page_id: r for r in html_text.op9_html_extraction(spark, FOLDER).collect()}
    assert len(found) == len(pages)
    for page in pages:
        own = re.search(r"<article>(.*)</article>", page.html, re.DOTALL)[1]
        own = re.split(r"</?(?:h1|p)>", re.sub(r"<(?!/?(?:h1|p)>)[^>]*>", " ", own))
        own = [re.sub(r"\s+", " ", html.unescape(block)).strip() for block in own]
        row = found[page.page_id]
        assert row.text == "\n".join(filter(None, own))
        assert (row.url, row.n_chars) == (page.url, len(row.text))


def test_tables(spark):
    rows = [(1, "u", PAGES["plain"][0]), (1, "u", PAGES["plain"][0]), (None, None, None), (2, "v", "<p>" + LONG * 20_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("?"), "a.b": F.lit(1)})
    found = html_text.extract(table).collect()
    texts = {(r.page_id, r.url, len(r.text)) for r in found}
    assert len(found) == 4 and texts == {(1, "u", len(PAGES["plain"][1])), (None, None, 0), (2, "v", len(LONG) * 20_000)}
    assert html_text.extract(table.limit(0)).count() == 0


OTHERS = {
    "ru": "Буря, которая пришла вечером с холмов, была одной из самых сильных, какие видели в долине за многие годы жизни.",
    "el": "Η καταιγίδα που ήρθε το βράδυ από τους λόφους ήταν μια από τις χειρότερες που είχαν δει ποτέ στην κοιλάδα.",
    "ar": "كانت العاصفة التي جاءت من التلال في المساء واحدة من أسوأ العواصف التي رآها أي شخص في الوادي منذ سنوات طويلة جدا",
    "zh": "傍晚从山上刮来的暴风雨是山谷里的人们见过的最严重的一次。" * 4,
    "fi": "Illalla kukkuloilta saapunut myrsky oli yksi pahimmista, joita laaksossa oli koskaan nähty vuosikymmenien aikana.",
}


@pytest.mark.parametrize("lang", OTHERS)
def test_other_languages(lang):
    text = OTHERS[lang]
    assert len(text) >= html_text.LONG
    page = f"<div><ul><li><a href=/>Home</a></ul><p>{text}</p><p>{text[:20]}</p><p>{text}</p><p>{'x1 2z ' * 40}</p></div>"
    assert html_text.main_text(page) == f"{text}\n{text[:20].strip()}\n{text}"


def test_other_script_beside_a_listed_language():
    text = OTHERS["ru"]
    assert html_text.main_text(f"<p>{text}</p><p>{LONG}</p>") == f"{text}\n{LONG}"


def test_short_paragraphs():
    page = "<ul><li><a href=/>Home</a></ul><p>The cat sat.</p><p>It was on a mat.</p><p><a>Next</a></p>"
    assert html_text.main_text(page) == "The cat sat.\nIt was on a mat."


ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>{OTHER}</p>"
WRAPPED = {
    "has": f"<div class='layout has-sidebar'>{ARTICLE}</div>",
    "no": f"<div class='no-sidebar'><article>{ARTICLE}</article></div>",
    "with": f"<section class='with-comments'>{ARTICLE}</section>",
    "print": f"<div id='print-area'>{ARTICLE}</div>",
    "print article": f"<div id='print-area'><article>{ARTICLE}</article><p>{OTHER}</p></div>",
    "modal main": f"<div class='modal'><div><main>{ARTICLE}<div class='related'>{OTHER}</div></main></div></div>",
    "header": f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p><p>{OTHER}</p></article>",
    "custom": f"<app-page class='search'>{ARTICLE}</app-page>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped(name):
    assert html_text.main_text(WRAPPED[name]) == f"Title\n{LONG}\n{OTHER}"


def test_hints_still_count():
    comments = f"<div class='comments'><article class='comment'><p>{OTHER}</p></article></div>"
    assert html_text.main_text(f"<article><p>{LONG}</p></article>{comments}") == LONG
    assert html_text.main_text(f"<div><p>{LONG}</p><p>By <span class='byline'>{OTHER}</span></p></div><div class='sidebar'>{OTHER}</div>") == f"{LONG}\nBy"


BODY = f"<p>{LONG}</p><p>{OTHER}</p>"
OPEN = {
    **{f"whole page in {name}": f"<body><{name} id=aspnetForm><nav>menu</nav>{BODY}</{name}></body>" for name in ("form", "menu", "fieldset", "dialog")},
    **{
        f"open {name}": f"<article><{name} src=x>{BODY}</article>"
        for name in ("audio", "video", "button", "canvas", "select", "object", "svg", "template")
    },
    "one open, one closed": f"<article><audio src=x>{BODY}<audio>old</audio></article>",
    "closed": f"<article><video><p>{OTHER}</p></video><button>Buy</button><select><option>a</select><svg><text>x</text></svg>{BODY}</article>",
    "objects in objects": f"<div><object><object>{OTHER}</object>{OTHER}</object>{BODY}</div>",
    "comments after main": f"<main>{BODY}</main><article><p>{OTHER}</p></article>",
    "comments in the article": f"<article>{BODY}<article><p>{OTHER}</p></article></article>",
    "a form beside": f"<div>{BODY}</div><form><p>{OTHER}</p></form>",
}


@pytest.mark.parametrize("name", OPEN)
def test_pages_are_not_emptied(name):
    assert html_text.main_text(OPEN[name]) == f"{LONG}\n{OTHER}"


def test_article_keeps_its_parts():
    page = f"<article><header><h1>Title</h1></header><p>{LONG} <math><mi>x</mi><mo>+</mo><mi>y</mi></math> holds.</p></article>"
    assert html_text.main_text(page) == f"Title\n{LONG} x+y holds."
    assert html_text.main_text(f"<article><p>{LONG}</p><p><a href=x>{OTHER}</a></p></article>") == f"{LONG}\n{OTHER}"
    assert html_text.main_text(f"<article><p>{LONG}</p><p><a href=x>Read more</a></p></article>") == LONG
    two = f"<article><p>{LONG}</p></article><article><p>{OTHER}</p></article>"
    assert html_text.main_text(two) == f"{LONG}\n{OTHER}"
    assert html_text.main_text(f"<article><article><p>{LONG}</p></article></article>") == LONG


class Plain(HTMLParser):
    """Blocks of well-formed pages with the standard library's parser: text, characters in links, the hinted elements around."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], ["", 0]
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join(self.now[0].split())
        if text:
            self.blocks.append((text, self.now[1], {i for i, e in enumerate(self.stack) if e[2]}))
        self.now = ["", 0]

    def handle_starttag(self, tag, given):
        block = tag in html_text.ENDS_P
        if block or tag == "hr":
            self.cut()
        if tag == "br":
            self.now[0] += " "
        if tag in html_text.VOID:
            return
        given = {k: v or "" for k, v in given}
        aside = tag in html_text.ASIDE or tag in ("head", "script", "style", "noscript", "button", "select", "svg", "iframe", "title", "textarea")
        hint = tag in html_text.HINTS or any(html_text.is_hint(given.get(k, "")) for k in ("class", "id"))
        self.stack.append((tag, aside or given.get("role") in html_text.ROLES or "hidden" in given, hint))

    def handle_endtag(self, tag):
        if tag in html_text.ENDS_P:
            self.cut()
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if not any(aside for _, aside, _ in self.stack):
            self.now[0] += data
            if any(tag == "a" for tag, _, _ in self.stack):
                self.now[1] += len(" ".join(data.split()))


def plain_text(page):
    """The two passes by definition, for pages without marked regions and in a listed language whose hints hold little; '' for others."""
    every = Plain(page).blocks
    own = [w for text, linked, _ in every if len(text) >= 80 and linked <= len(text) / 2 for w in re.findall(r"[^\W\d_]+", text.lower())]
    if sum(word in html_text.STOPS for word in own) < 0.08 * len(own):
        return ""
    blocks = [(text, linked) for text, linked, hints in every if not hints]
    labels = []
    for text, linked in blocks:
        own = re.findall(r"[^\W\d_]+", text.lower())
        if linked > (0.5 if len(text) >= 80 else 0.33) * len(text):
            labels.append(False)
        elif len(text) < 80:
            labels.append(None)
        else:
            labels.append(sum(word in html_text.STOPS for word in own) >= 0.08 * len(own))
    kept = []
    for k, (text, _) in enumerate(blocks):
        label = labels[k]
        if label is None:
            near = [min((abs(j - k), j) for j in side) for side in ([j for j in range(k) if labels[j] is not None], [j for j in range(k + 1, len(blocks)) if labels[j] is not None]) if side]
            label = bool(near) and labels[min(near, key=lambda x: (x[0], not labels[x[1]]))[1]]
        if label:
            kept.append(text)
    return "\n".join(kept)


def test_given_tables_without_their_marks(spark):
    """A second implementation on the given pages, their article tags taken out."""
    checked = 0
    for page in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        bare = re.sub(r"</?(?:article|main)\b[^>]*>", "", page.html)
        expected = plain_text(bare)
        if expected:
            checked += 1
            assert html_text.main_text(bare) == expected
    assert checked > 100
