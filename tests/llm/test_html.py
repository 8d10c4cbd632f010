from rollcheck.llm import html as h

ARTICLE = "First, a sentence of the story, long enough to count. Second one here, with commas, too."


def test_article_only():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now, cheap, here, today.</div>
    <div class="cookie-notice">We use cookies, and more cookies, as you know.</div>
    <article><h1>Title &amp; all</h1><p><b>{ARTICLE}<br><p>Zweiter Absatz, &#228;hnlich lang,\n   noch ein Satz.</p><ul><li>point one<li>point two</ul></article>
    <aside>Other stories, read them.</aside><div id="comments"><p>I disagree, strongly, with all of this, really.</p></div>
    <form><p>Sign up, now, please.</p></form><footer>&copy; 2020, all rights</footer></body></html>"""
    assert h.main_text(page) == f"Title & all {ARTICLE} Zweiter Absatz, ähnlich lang, noch ein Satz. point one point two"


def test_without_article_tag():
    page = f"<body><div class='menu'><a>x</a></div><div id=wrap><div id=main><h2>Head</h2><p>{ARTICLE}</p><p>{ARTICLE}</p><p>Short.</p></div><div class=sidebar><p>{ARTICLE}</p></div></div></body>"
    assert h.main_text(page) == f"Head {ARTICLE} {ARTICLE} Short."


def test_names_of_surroundings():
    for words in ("ad", "cookie-notice", "post-footer", "article-comments", "comment-list", "site-header", "main-nav", "sidebar"):
        assert h.surrounds(words)
    for words in ("post", "has-sidebar", "article-header", "entry-content", "shadow", "reading"):
        assert not h.surrounds(words)


def test_edges():
    assert h.main_text(None) == "" and h.main_text("") == ""
    assert h.main_text("<html><body><nav>a</nav></body></html>") == ""
    assert h.main_text("just text, no markup") == "just text, no markup"
    assert h.main_text("<article><p>a &lt; b</p><p>x</p></article>") == "a < b x"
    assert h.main_text("<article><p>one<script>if (a</b) x</script> two</p></article>") == "one two"
    assert "kept" in h.main_text("<article><p class=\"x>kept text</p></article>")
    assert len(h.main_text("<p>" * 50_000 + "deep " * 10)) > 0
    assert len(h.main_text("<div>" * 3_000 + "deep, " * 100)) > 0


def test_rows(spark):
    rows = [(1, "u", "<p>Hello, this is a paragraph of text.</p>", "x"), (1, "u", "<p>Hello, this is a paragraph of text.</p>", "x"), (2, None, None, "x"), (None, "v", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text) for r in h.extract(df).collect())
    assert got == [("1", "u", "Hello, this is a paragraph of text.")] * 2 + [("2", "None", ""), ("None", "v", "")]
    assert h.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = " ".join(h._blocks(h.parse(f"<div>{body}</div>")))
        assert h.main_text(r.html) == want


def test_text_inside_elements_named_like_surroundings():
    for name in ("content-with-sidebar", "elementor-widget", "page-with-sidebar", "layout-right-sidebar", "legal-article"):
        page = f"<body><div class=menu><a>x</a></div><div class={name}><p>{ARTICLE}</p><p>{ARTICLE}</p></div><p>Short, but a sentence here.</p><div class=comments><p>{ARTICLE * 9}</p></div></body>"
        assert f"{ARTICLE} {ARTICLE}" in h.main_text(page) and ARTICLE * 2 not in h.main_text(page)
    page = f"<body><div id=wrap><p>{ARTICLE}</p></div><div class=comments><p>{ARTICLE * 9}</p></div></body>"
    assert h.main_text(page) == ARTICLE
    assert h.main_text("<body><nav>a</nav></body>") == ""


def test_elements_left_out_end_without_end_tags():
    assert h.main_text(f'<article><p class="share">Share this<p>{ARTICLE}<p>{ARTICLE}</article>') == f"{ARTICLE} {ARTICLE}"
    assert h.main_text(f'<ul><li class="nav-item">Home<li class="nav-item">About</ul><article><p>{ARTICLE}</article>') == ARTICLE
    assert h.main_text(f'<table><tr><td class="menu">Home<td><p>{ARTICLE}</p><p>{ARTICLE}</p></table>') == f"{ARTICLE} {ARTICLE}"
    assert h.main_text(f'<div><ul><li class="nav"><ul><li>x<li>y</ul>z<li>w</ul><p>{ARTICLE}</p></div>').endswith(ARTICLE)


def test_page_inside_a_form():
    body = f"<div id=main><p>{ARTICLE}</p><p>{ARTICLE}</p><p>{ARTICLE}</p></div>"
    assert h.main_text(f"<body><form id=aspnet><div class=menu><a>x</a></div>{body}</form></body>") == f"{ARTICLE} {ARTICLE} {ARTICLE}"
    assert h.main_text("<body><form><p>Sign up here, please, with your name.</p></form></body>") == ""


def test_forms_and_adverts_stay_out():
    long = "<div><p>Your name, your mail and your wishes go here, please, so that we can write to you. " * 4 + "</p></div>"
    page = f"<body><article><p>A short article, of one sentence only here.</p></article><form action=x>{long}</form></body>"
    assert h.main_text(page) == "A short article, of one sentence only here."
    page = f"<body><div id=content><p>{ARTICLE}</p><p>{ARTICLE}</p></div><form><p>{'Log in, with your name. ' * 30}</p></form></body>"
    assert h.main_text(page) == f"{ARTICLE} {ARTICLE}"
    for name in ("ad", "cookie-consent", "comments", "newsletter-box"):
        assert h.main_text(f"<body><div class='{name}'><p>{ARTICLE}</p><p>{ARTICLE}</p></div></body>") == ""
    inner = f"<h1>Site</h1><form id=page><div id=main><p>{ARTICLE}</p><p>{ARTICLE}</p><form><p>{ARTICLE}</p></form></div><fieldset><p>Pick one, of these, please, now.</p></fieldset></form>"
    got = h.main_text(f"<body>{inner}</body>")
    assert got.startswith(f"{ARTICLE} {ARTICLE}") and "Pick" not in got


def independent(page):
    """The text of well-formed pages by the standard library's parser: the one article element's blocks, without what is left out."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.out, self.run = [], [], []

        def handle_starttag(self, tag, attrs):
            if tag in h.BLOCKS:
                self.end()
            if tag not in h.VOID:
                self.open.append((tag, dict(attrs).get("class") or ""))

        def handle_endtag(self, tag):
            if tag in h.BLOCKS:
                self.end()
            while self.open and self.open.pop()[0] != tag:
                pass

        def handle_data(self, data):
            names = [t for t, _ in self.open]
            if "article" in names and not any(t in h.DROPPED or c in ("ad", "share") for t, c in self.open):
                self.run.append(data)

        def end(self):
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                self.out.append(text)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.end()
    return " ".join(reader.out)


def test_made_pages_against_another_parser():
    import random

    rng = random.Random(8)
    inline = ["plain words, and more", "<b>bold</b> text", "a &amp; b &lt; c", "<a href=x>link</a> here", "line<br>break", "<i>x</i>&#228;", "<span>spaced\n  out</span>", "<script>var x = '<p>';</script>done"]
    for _ in range(300):
        paragraph = lambda: f"<p>{' '.join(rng.choice(inline) for _ in range(rng.randint(3, 9)))}, with a full sentence, too.</p>"
        parts = [rng.choice([paragraph, lambda: f"<h2>{rng.choice(inline)}</h2>", lambda: "<ul><li>one point</li><li>two points</li></ul>", lambda: f"<blockquote>{paragraph()}</blockquote>", lambda: "<div class=ad><p>Buy this, cheap.</p></div>", lambda: "<form><p>Fill this in.</p></form>"])() for _ in range(rng.randint(2, 8))]
        page = f"<html><body><nav><a>Home</a></nav><article>{paragraph()}{''.join(parts)}{paragraph()}</article><footer>rights</footer></body></html>"
        assert h.main_text(page) == independent(page)
