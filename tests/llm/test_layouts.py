"""Main text on layouts whose wrappers carry words of furniture, alone and by the consensus of a host."""

import cases
import pytest

from tablewright.llm import html

STORY = "A long sentence of the story goes on here. " * 24
TEXT = STORY.strip()
LAYOUTS = {
    "sidebar": ('<div class="layout has-sidebar"><article><h1>T{0}</h1><p>' + STORY + '</p></article><div class="sidebar">side <a href=x>l</a></div></div>', "T{0} " + TEXT),
    "open comments": ('<div id="content" class="post comments-open"><h1>T{0}</h1><p>' + STORY + "</p></div>", "T{0} " + TEXT),
    "form": ("<body><form><h1>T{0}</h1><p>" + STORY + "</p><input><button>go</button></form></body>", "T{0} " + TEXT),
    "search": ('<div class="search-page"><main><h1>T{0}</h1><p>' + STORY + "</p></main></div>", "T{0} " + TEXT),
    "headings": ('<article><h2 id="related-work">Related {0}</h2><p>' + STORY + '</p><h2 id="search-algorithms">Search</h2></article>', "Related {0} " + TEXT + " Search"),
    "two articles": ("<body><article><p>" + STORY + "</p></article><article><p>second {0}</p></article></body>", TEXT + " second {0}"),
    "readers": ('<body><div class="post"><h1>T{0}</h1><p>' + STORY + '</p></div><div id="comments"><div class="comment"><p>' + STORY * 2 + "reader</p></div></div></body>", "T{0} " + TEXT),
    "reader articles": ("<body><article><h1>T{0}</h1><p>" + STORY + '</p></article><section class="comments"><article class="comment"><p>' + STORY * 3 + "</p></article></section></body>", "T{0} " + TEXT),
    "site title": ('<body><header><h1>Site</h1></header><div class="layout has-sidebar"><div class="text"><h2>T{0}</h2><p>' + STORY + '</p></div><div class="sidebar"><p>' + STORY[:90] + "</p></div></div></body>", "T{0} " + TEXT),
    "legal footer": ("<body><article><h1>T{0}</h1><p>" + STORY + "</p></article><footer>" + STORY * 2 + "</footer></body>", "T{0} " + TEXT),
    "notice": ('<body><article><h1>T{0}</h1><div class="cookie-notice">We use cookies</div><p>' + STORY + '</p><p class="advert">Buy</p></article></body>', "T{0} " + TEXT),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_a_page_alone(name):
    page, want = LAYOUTS[name]
    assert html.extract(page.format(1), None) == want.format(1)
    assert html.extract(page.format(1), [html.best_path(page.format(2))]) == want.format(1)


def test_the_consensus_of_hosts(spark):
    rows, want = [], {}
    for h, (page, text) in enumerate(LAYOUTS.values()):
        for k in range(6):
            rows.append((100 * h + k, f"https://h{h}.example/p{k}", page.format(k)))
            want[100 * h + k] = text.format(k)
    rows += [(9000, None, LAYOUTS["form"][0].format(0)), (9001, "https://h0.example/empty", None), (9002, "https://h0.example/", "")]
    want |= {9000: LAYOUTS["form"][1].format(0), 9001: "", 9002: ""}
    pages = cases.with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in html.query(pages).collect()} == want


def test_every_path_that_pages_agree_on_is_taken(spark):
    """A host with many layouts: a rare one is still extracted by its own path."""
    rows = []
    for layout in range(8):
        tag = "abcdefgh"[layout] * 4
        for k in range(12 - layout):
            rows.append((100 * layout + k, "https://many.example/", f'<body><div class="{tag}"><h1>T{k}</h1><p>{STORY}</p></div><div class="zzz"><p>{STORY[:300]}</p></div></body>'))
    # on this page another block is longer, but two pages and more agree on its layout
    rows.append((9000, "https://many.example/", f'<body><div class="hhhh"><h1>Short</h1><p>{STORY[:400]}</p></div><div class="yyyy"><p>{STORY}</p></div></body>'))
    got = {r.page_id: r.text for r in html.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9000] == "Short " + STORY[:400].strip() and all(got[i].startswith("T") for i, *_ in rows[:-1])


def test_a_very_long_page():
    page = "<article>" + "".join(f"<p>{STORY}{k}</p>" for k in range(3000)) + "</article>"
    assert html.extract(page, None) == " ".join(f"{STORY}{k}" for k in range(3000))
