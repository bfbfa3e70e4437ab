import itertools
import random
from collections import Counter
from html.parser import HTMLParser

from urlintel.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body class="with-sidebar">
<header><h1>Site</h1><nav><a href=/>Home</a> <a href=/b>B</a></nav></header><div class="cookie-notice">We use cookies.</div>
<div id=wrap><aside><p>Side story, with a long sentence about something else altogether.</p></aside>
<article><h1>Head &amp; line</h1><p><b>First   part<br>goes on.<p>Second&nbsp;one, a &lt; b.</p><div class="ad">Buy now!</div><ul><li>One</li><li>Two</li></ul>
<script>var t="</p>";</script><form><label>Mail</label><input name=q></form><p>End &copy; it.</p>
<section class="comments"><article><p>I liked this very much, says a reader.</p></article></section></article></div><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert h.main_text(PAGE) == "Head & line\n\nFirst part goes on.\n\nSecond one, a < b.\n\nOne\n\nTwo\n\nEnd © it."


def test_page_without_landmarks():
    page = "<div><a href=1>Home</a></div>" + "".join(f"<p>This is paragraph {i} of a longer text, with several words in it.</p>" for i in range(4)) + "<div><a href=2>Next</a></div>"
    assert h.main_text(page).count("\n\n") == 3 and "Home" not in h.main_text(page)


def test_odd_pages(spark):
    assert [h.main_text(x) for x in (None, "", "<", "<p", "<nav>x", "<article>a<p>b<foo")] == ["", "", "", "", "", "a\n\nb"]
    assert h.main_text("<article>" + "<div><p>word and word.</p>" * 5000) == "\n\n".join(["word and word."] * 5000)
    df = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 4)], "page_id long, url string, html string, n_chars int")
    rows = [tuple(r) for r in h.extract(df).collect()]
    assert rows[0] == rows[1] and rows[2] == (2, None, "", 0) and rows[0][3] == len(rows[0][2])
    assert h.extract(df.limit(0)).count() == 0


def test_cut_is_least():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 7)
        scores = [r.choice([-3, -1, -0.5, 0.25, 1, 2.5]) for _ in range(n)]
        edges = [(a, b, r.choice([0.1, 0.5, 1.5])) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]

        def cost(label):
            return sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, label)) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(h.min_cut(scores, edges)) - best) < 1e-6


def test_inline_element_ends_at_its_end_tag():
    for mark in ('<span class="share">Share</span>', '<i class="fa fa-share"></i>', '<i class="icon-search"></i>', '<span class="share"><span>Share</span> it</span>'):
        assert h.main_text(f"<article><h1>T</h1>{mark}<p>Body 1</p><p>Body 2</p></article>").endswith("T\n\nBody 1\n\nBody 2"), mark
    assert h.main_text('<article><p>Before <i class="icon-share"></i> and after.</p></article>') == "Before and after."
    assert h.main_text('<article><p>One<span class="share">Share</span>two <b class="ad">Buy<p>Three</b> four</article>') == "One two\n\nThree four"
    assert h.main_text('<article><b><span class="share">x</b> y</span> z</article>') == "z"


def test_words_of_boilerplate_are_outweighed_by_text():
    text = [f"This is paragraph {i} of a longer text, and it has several words in it." for i in range(4)]
    body = "".join(f"<p>{t}</p>" for t in text)
    for name in ("content with-sidebar", "elementor-widget", "post has-comments", "page has-header-image"):
        assert h.main_text(f'<div class="{name}"><div>{body}</div></div>') == "\n\n".join(text), name
        assert h.main_text(f'<article class="{name}">{body}<div class="newsletter">Get our letter.</div></article>') == "\n\n".join(text), name
    for name in ("comments", "sidebar", "cookie-notice", "related"):
        assert h.main_text(f'<article>{body}</article><div class="{name}"><p>See what others say of it.</p></div>') == "\n\n".join(text), name


def test_unclosed_elements_references_and_words_in_classes():
    for tag in ("svg", "object data=x", "canvas", "noscript", "math", "video"):
        assert h.main_text(f"<article><p>One is here.</p><{tag}><p>Two is after it.</p></article>") == "One is here.\n\nTwo is after it.", tag
    for tag in ("script", "style", "textarea"):
        assert h.main_text(f"<article><p>One is here.</p><{tag}><p>var x;</p></article>") == "One is here.", tag
    assert h.main_text("<article><p>x &<b>amp;</b> y &amp;lt; &#8212; &nbsp;z</p></article>") == "x &amp; y &lt; \u2014 z"
    assert h.main_text('<article><p class="form">Poem of lines.</p><p>More of it.</p></article>') == "Poem of lines.\n\nMore of it."
    assert h.main_text('<div class="layout with-sidebar"><article><h1>Title</h1><p>Some text.</p></article></div>') == "Title\n\nSome text."
    assert h.main_text('<article><p>Before <span class="share">S</span> after it.</p><p>Next paragraph here.</p></article>') == "Before after it.\n\nNext paragraph here."


class Article(HTMLParser):
    """The blocks of the article element, by the standard library's tokenizer: the given pages have no boilerplate within it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "i", "a"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag not in ("b", "i", "a"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_precision_and_recall_on_given_pages(spark):
    hit = found = wanted = same = n = 0
    for row in h.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        reader = Article()
        reader.feed(row["html"] or "")
        blocks = [" ".join(b.split()) for b in reader.blocks]
        want = "\n\n".join(b for b in blocks if b)
        a, b = Counter(row["text"].split()), Counter(want.split())
        hit, found, wanted = hit + (a & b).total(), found + a.total(), wanted + b.total()
        same, n = same + (want == row["text"]), n + 1
    assert n > 200 and hit >= 0.995 * found and hit >= 0.995 * wanted and same >= 0.98 * n, (hit / found, hit / wanted, same / n)


BOX_NAMES = (
    'class="comment-list"', 'class="commentlist"', 'id="disqus_thread"', 'class="related-posts"', 'class="ad-container"', 'class="widget-area"', 'class="cookie-bar"', 'class="user-reviews"', 'class="comments"', 'id=comments',
    'class="relatedPosts"', 'class="post-comments clearfix"', 'itemprop="comment"', 'class="adsbygoogle"', 'class="sponsored-links"', 'class="share-buttons"', 'class="newsletter-box"', 'id="right-sidebar"', 'class="promo-banner"', 'class="customer_reviews"',
)
KEPT_NAMES = ('class="content with-sidebar"', 'class="post has-comments"', 'class="elementor-widget"', 'class="category-social tag-ads"', 'id="story"', 'class="no-comments"', 'class="review"')


def composed(shape, box, long, at):
    """A page of one kind of markup with a box in some place, and its article."""
    text = [f"The {w} paragraph of this piece says something of its own, and it ends here." for w in ("first", "second", "third", "fourth", "fifth")]
    own = " ".join(["I have thought about this for a long time, and I agree with all that was said here."] * (12 if long else 1))
    tags = {"ul": f"<ul {box}><li><p>Ann</p><p>{own}</p></li><li>{own}</li></ul>", "div": f"<div {box}><h3>More</h3><p>{own}</p><p>{own}</p></div>", "section": f"<section {box}><article><p>{own}</p></article></section>"}
    piece = tags[("ul", "div", "section")[len(box) % 3]]
    body = [f"<p>{t}</p>" for t in text]
    inside, beside = ("".join([*body[:3], piece, *body[3:]]), "") if at == "middle" else ("".join([*body, piece]), "") if at == "end" else ("".join(body), piece)
    pages = {
        "article": f"<body><nav><a href=/>Home</a></nav><article><h1>A title</h1>{inside}</article>{beside}<footer>Imprint</footer></body>",
        "main": f"<body><header>Site</header><main><h1>A title</h1>{inside}</main>{beside}</body>",
        "divs": f"<body><div class=top><a href=/>Home</a></div><div id=page><div class=entry><h1>A title</h1>{inside}</div>{beside}</div></body>",
        "section": f"<body><section class='post'><h1>A title</h1>{inside}</section>{beside}</body>",
    }
    return pages[shape], "\n\n".join(["A title", *text])


def test_composed_pages():
    """Boxes of all names go from pages of all kinds, short and long, inside the article and beside it; other names stay."""
    hit = found = wanted = same = n = 0
    cases = itertools.product(("article", "main", "divs", "section"), BOX_NAMES, (False, True), ("middle", "end", "beside"))
    for shape, box, long, at in cases:
        page, want = composed(shape, box, long, at)
        got = h.main_text(page)
        a, b = Counter(got.split()), Counter(want.split())
        hit, found, wanted = hit + (a & b).total(), found + a.total(), wanted + b.total()
        same, n = same + (got == want), n + 1
        if shape == "article":
            assert got == want, (box, long, at)
    assert n == 480 and hit >= 0.99 * found and hit >= 0.98 * wanted and same >= 0.95 * n, (hit / found, hit / wanted, same / n)
    text = "".join(f"<p>This is paragraph {i} of a longer text, and it has several words in it.</p>" for i in range(4))
    for name in KEPT_NAMES:
        assert h.main_text(f"<div {name}>{text}</div>").count("paragraph") == 4, name
        assert h.main_text(f"<article {name}>{text}</article>").count("paragraph") == 4, name
    assert h.main_text(f'<body class="comments"><article>{text}</article></body>').count("paragraph") == 4
