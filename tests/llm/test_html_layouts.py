"""Main text of hosts whose layouts, class words or headings mislead."""

import pytest

from wardline.llm.html_text import extract, main_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def body(i, n=30):
    return " ".join(f"{WORDS[(i + k * k) % 10]}{i * k % 97}" for k in range(n)) + "."


def texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", html) for i, (host, html, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(
        rows, "page_id long, url string, html string").repartition(3)).collect()}
    return [got[i] for i in range(len(pages))], [want for *_, want in pages]


def layouts(n):
    """Pages (host, html, text): every host of n pages."""
    out = []
    for i in range(n):
        text = body(i)
        # the wrapper of everything has a listed word
        out.append(("wrapped.org", f'<body><div class="layout with-sidebar"><div class="text"><p>{text}</p></div>'
                    '<div class="sidebar">Latest news</div></div></body>', text))
        # headings that all articles share
        out.append(("headings.org", f"<body><nav>Menu</nav><article><h2>Summary</h2><p>{text}</p><h2>Conclusion</h2>"
                    f"<p>{body(i + 50)}</p></article></body>", f"Summary {text} Conclusion {body(i + 50)}"))
        # a side column without a listed word
        out.append(("column.org", f'<body><div class="left"><p>{text}</p><p>{body(i + 70)}</p></div>'
                    '<div class="right"><p>Teaser of the day</p></div></body>', f"{text} {body(i + 70)}"))
        # three layouts, their classes differ per section
        section = ("sport", "local", "world")[i % 3]
        out.append(("sections.org", f'<body class="{section}"><div class="{section}-text"><p>{text}</p></div>'
                    f'<div class="{section}-more"><p>Teaser</p></div></body>', text))
        # comments longer than the article
        out.append(("comments.org", f'<body><article><p>{text}</p></article><div class="comments"><article class="comment">'
                    f"{body(i + 30, 90)}</article></div></body>", text))
    return out


@pytest.mark.parametrize("n", [5, 9, 19, 20, 25])
def test_layouts(spark, n):
    pages = layouts(n)
    got, want = texts(spark, pages)
    # each section of the three layouts has fewer than three pages among five: no template
    few = [h == "sections.org" and n < 9 for h, *_ in pages]
    assert [g for g, f in zip(got, few) if not f] == [w for w, f in zip(want, few) if not f]


@pytest.mark.parametrize("wrapper", [
    'class="content no-ads"', 'class="page-header-fixed"', 'class="widget-area-none"', 'id="search-engine-news"'])
def test_a_listed_word_around_the_article(wrapper):
    page = f'<body><div {wrapper}><h1>Title</h1><p>{body(3)}</p></div><div class="ads">Buy</div></body>'
    assert main_text(page, frozenset()) == f"Title {body(3)}"


def test_very_long_page():
    text = " ".join(body(i) for i in range(20_000))
    page = f"<body><nav>x</nav><article>{'<div>' * 200}{text}{'</div>' * 200}</article><div class=share>s</div>"
    assert main_text(page, frozenset()) == text
