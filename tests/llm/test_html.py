from html.parser import HTMLParser

import pytest

from drillbook.llm import html_text as ht

PAGES = "page_id long, url string, html string"


def text(html, paths=()):
    return ht.main_text(html, list(paths))


ARTICLE = "<p>First paragraph of the article, long enough to count.</p><p>Second one, with more words.</p>"
WANT = "First paragraph of the article, long enough to count.\nSecond one, with more words."


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("<nav>menu only</nav>", ""),
        ("plain words", "plain words"),
        (f"<body><nav><ul><li><a href=x>Home</a></ul></nav><article>{ARTICLE}</article><footer>f</footer>", WANT),
        (f"<div class='sidebar'>side text</div><div class=content>{ARTICLE}</div><div id=comments><p>nice!</div>", WANT),
        (f"<main><h1>Title  of\n it</h1>{ARTICLE}<form><p>Your mail</p><input></form></main>", "Title of it\n" + WANT),
        (f"<header><p>Site</p></header><article><header><h1>T</h1></header>{ARTICLE}</article>", "T\n" + WANT),
        (f"<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> -->{ARTICLE}", WANT),
        (f"<div class='cookie-notice'>We use cookies</div><article>{ARTICLE}<aside>more</aside></article>", WANT),
        ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;x &copy; &am</p></article>", "a & b <c> é x © &am"),
        ("<article><p>one<br>two <b>bo</b>ld</p><p>  </p><ul><li>i<li>j</ul></article>", "one two bold\ni\nj"),
        ("<article><p>5 < 6 and 7 > 3</p></article>", "5 < 6 and 7 > 3"),
        ("<article><p title='a > b'>quoted</p></article>", "quoted"),
        (f"<nav><ul><li>never closed<article>{ARTICLE}</article>", WANT),
        (f"<article>{ARTICLE}<p>cut off <b>he", WANT + "\ncut off he"),
        (f"<article><section>{ARTICLE}</section><section><p>Third part here.</p></section></article>", WANT + "\nThird part here."),
        ("<p>x</p><script>never closed <p>y</p>", "x"),
        ("<div hidden><p>not shown at all</p></div><p>shown</p>", "shown"),
    ],
)
def test_pages_alone(html, want):
    assert text(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<article>{ARTICLE}<p class='notice'>We use cookies.</p><p>After it.</p></article>", WANT + "\nAfter it."),
        (f"<article>{ARTICLE}<p>Before <span class='ad'>buy <span>this</span> now</span> and after.</p></article>", WANT + "\nBefore and after."),
        (f"<article>{ARTICLE}<ul><li class='advert'><p>buy</p><li>real item</ul></article>", WANT + "\nreal item"),
        (f"<article>{ARTICLE}<p><span class='ad'>never closed</p><p>After it.</p></article>", WANT + "\nAfter it."),
        (f"<article>{ARTICLE}<h3 class='newsletter-signup'>Sign up</h3></article>", WANT),
        (f"<article>{ARTICLE}<p title='the hidden truth' class='lead'>Kept.</p></article>", WANT + "\nKept."),
        (f"<article>{ARTICLE}<p hidden>no</p><p>so <i style='display:none'>no</i>yes</p></article>", WANT + "\nso yes"),
        ("<p class='notice'>all there is</p>", "all there is"),
        ("<p><span class='ad'>all there is</span></p>", "all there is"),
        (f"<div>{ARTICLE}</div><div class='user-comments'><p>nice one!</p></div>", WANT),
        (f"<div>{ARTICLE}</div><div id='post-comments'><p>nice one!</p></div>", WANT),
        (f"<div>{ARTICLE}<p class='post-title'>Kept.</p></div>", WANT + "\nKept."),
        (f"<div><p>{'column ' * 90}</p></div><article>{ARTICLE}</article>", WANT),
        (f"<body><div><p>{'column ' * 90}</p></div><main><h1>T</h1><article>{ARTICLE}</article></main></body>", "T\n" + WANT),
        (f"<article>a</article><div>{ARTICLE}</div>", "a\n" + WANT),
        (f"<article>{ARTICLE}</article><div><p>between</p></div><article><p>third</p></article>", WANT + "\nbetween\nthird"),
    ],
)
def test_words_on_any_element(html, want):
    """Notices, adverts and talk go whatever element holds them; the only article stands for its page."""
    assert text(html) == want


def test_a_host_leaves_out_small_parts_only(spark):
    """Where a page's article is mostly in a part that others of its host leave out, it stays."""
    page = "<div class=wrap><nav>" + "menu " * 30 + "</nav><div class=text><p>{}</p></div><div class=more><p>{}</p></div></div>"
    pages = [(i, f"http://a.example/{i}", page.format("words " * 60, "see also")) for i in range(5)]
    pages.append((9, "http://a.example/9", page.format("words " * 10, "more " * 76)))
    found = {r["page_id"]: r["text"] for r in ht.extract_text(spark.createDataFrame(pages, PAGES)).collect()}
    assert found[9] == ("words " * 10).strip() + "\n" + ("more " * 76).strip()


LONG = f"<p>{'article ' * 125}</p>"


@pytest.mark.parametrize("part", ["blockquote", "ul", "table", "section", "div"])
def test_comments_longer_than_the_article(part):
    """A piece of the article that has no comments inside must not win over it."""
    page = f"<article>{LONG}<{part}>{'piece ' * 50}</{part}><section class=comments><p>{'talk ' * 300}</p></section></article>"
    assert text(page) == ("article " * 125).strip() + "\n" + ("piece " * 50).strip()


def test_sibling_parts_beside_long_comments():
    page = f"<body><div class=one>{LONG}</div><div class=two><p>{'more ' * 150}</p></div><div id=comments><p>{'talk ' * 900}</p></div>"
    assert text(page) == ("article " * 125).strip() + "\n" + ("more " * 150).strip()


@pytest.mark.parametrize(
    "before, after",
    [
        ("<body class='has-sidebar'>", "</body>"),
        ("<body class='home sidebar'>", "</body>"),
        ("<div class='layout no-sidebar'>", "</div>"),
        ("<div id='search-page'>", "</div>"),
        ("<article class='post comments-open'>", "</article>"),
        ("<div class='content alert-level-2'>", "</div>"),
        ("<div class='widget'>", "</div>"),
        ("<form action='x.aspx'>", "</form>"),
    ],
)
@pytest.mark.parametrize("part", ["<div class='{}'><p>short extra</p></div>", "<ul id={}><li>short extra</ul>"])
@pytest.mark.parametrize("name", ["sidebar", "comments-area", "site-footer", "ad-slot-2", "share"])
def test_wrappers_are_not_dropped_for_a_word(before, after, part, name):
    assert text(f"{before}{ARTICLE}{part.format(name)}{after}<p>and after</p>") == WANT + "\nand after"


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<form><h1>Title</h1><article>{ARTICLE}</article><p>tail</p></form>", "Title\n" + WANT + "\ntail"),
        ("".join(f"<div class=widget><p>part {i}</p></div>" for i in range(9)), "\n".join(f"part {i}" for i in range(9))),
        (f"<div class=wrap><p>lead</p><form>{ARTICLE}</form></div>", "lead\n" + WANT),
    ],
)
def test_pages_inside_doubtful_parts(html, want):
    assert text(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ('<p>one</p><svg class="i"/><p>rest of article</p>', "one\nrest of article"),
        ("<p>one</p><svg class='a > b' /><p>two</p><SVG><text>no</text></SVG><p>three</p>", "one\ntwo\nthree"),
        ("<p>one</p><svg><path d='x'/><text>no</text></svg><p>two</p>", "one\ntwo"),
        ("<p>one</p><math display='block'/><p>two</p>", "one\ntwo"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "so x=1 holds"),
    ],
)
def test_drawings_and_formulas(html, want):
    assert text(html) == want


def test_a_page_of_links_only():
    page = "<body><div><p><a href=x>first link</a></p></div><div><p><a href=y>second link</a></p></div>"
    assert text(page) == "first link\nsecond link"


def test_hosts_agree_on_a_path(spark):
    """A page whose comments outweigh its article follows the other pages of its host."""
    body = "<body><nav>" + "menu " * 30 + "</nav><div class='post-{i}'><p>{article}</p></div><div class=thread><p>{talk}</p></div></body>"
    pages = [
        (i, f"https://u@Host.example:80/{i}", body.format(i=i, article="words " * 50, talk="no " * 3))
        for i in range(5)
    ]
    pages.append((9, "http://host.example/9", body.format(i=9, article="short article", talk="yes " * 9)))
    pages.append((10, "http://other.example/", body.format(i=1, article="short article", talk="yes " * 200)))
    frame = spark.createDataFrame(pages, PAGES)
    found = {r["page_id"]: r["text"] for r in ht.extract_text(frame).collect()}
    assert found[9] == "short article"
    assert found[10] == ("yes " * 200).strip()
    assert found[0] == ("words " * 50).strip()


def test_a_host_path_does_not_cut_the_page(spark):
    """One page goes on in a part that the others of its host don't have."""
    page = "<div class=wrap><nav>" + "menu " * 30 + "</nav><div class=post><p>{}</p></div>{}</div>"
    pages = [(i, f"http://a.example/{i}", page.format("words " * 40, "")) for i in range(5)]
    pages.append((9, "http://a.example/9", page.format("words " * 40, f"<div class=more><p>{'more ' * 72}</p></div>")))
    found = {r["page_id"]: r["text"] for r in ht.extract_text(spark.createDataFrame(pages, PAGES)).collect()}
    assert found[0] == ("words " * 40).strip()
    assert found[9] == ("words " * 40).strip() + "\n" + ("more " * 72).strip()


def test_awkward_rows(spark):
    rows = [
        (1, None, None),
        (2, "no url at all", ""),
        (None, "http://a.b/", f"<article>{ARTICLE}</article>"),
        (3, "http://a.b/", f"<article>{ARTICLE}</article>"),
        (3, "http://a.b/", f"<article>{ARTICLE}</article>"),
        (4, None, "<p>" + "long " * 100_000 + "</p>"),
        (5, "http://a.b/x", "<div>" * 3000 + "deep" + "</div>" * 3000),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES + ", host string, paths string")
    found = sorted(((r["page_id"], r["text"]) for r in ht.extract_text(frame).collect()), key=repr)
    want = [(1, ""), (2, ""), (None, WANT), (3, WANT), (3, WANT), (4, ("long " * 100_000).strip()), (5, "deep")]
    assert found == sorted(want, key=repr)
    for row in ht.extract_text(frame).collect():
        assert row["n_chars"] == len(row["text"])


def test_empty_table(spark):
    assert ht.extract_text(spark.createDataFrame([], PAGES)).count() == 0


class Reader(HTMLParser):
    """The whole tree, no voting: blocks of the article but for parts that are not its text."""

    VOID = {"br", "img", "hr", "meta", "link", "input"}
    NOT_TEXT = {"script", "style", "nav", "aside", "footer", "form", "button", "noscript", "template", "svg", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], []

    def close_block(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        if tag in ht.BLOCKS:
            self.close_block()
        if tag not in self.VOID:
            words = {word for name, value in attrs if name in ("class", "id") for word in (value or "").split()}
            self.open.append((tag, tag in self.NOT_TEXT or bool(words & {"ad", "comments", "sidebar", "menu"})))

    def handle_endtag(self, tag):
        if tag in ht.BLOCKS:
            self.close_block()
        if any(name == tag for name, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        inside = [name for name, _ in self.open]
        if "article" in inside and not any(dropped for _, dropped in self.open):
            self.now.append(data)


def test_all_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in ht.extract_text(pages).collect()}
    other = []
    for row in pages.select("page_id", "html").collect():
        reader = Reader()
        reader.feed(row["html"] or "")
        reader.close()
        reader.close_block()
        if "\n".join(reader.blocks) != found[row["page_id"]]:
            other.append(row["page_id"])
    assert len(found) == pages.count() and not other
