import html as codes
import random
import re

import pytest

from strata.llm import html_text
from strata.llm.html_text import extract, main_text

LONG = "This paragraph is long enough to be running text, with commas, and goes on for a while so that a window surges."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain words", "plain words"),
        (f"<body><nav><a>menu</a></nav><article><h1>T&amp;T</h1><p>{LONG}<p>a<br>b &lt;c&gt;</p></article><footer>foot</footer>", f"T&T\n{LONG}\na b <c>"),
        (f"<div class='sidebar'><p>{LONG}</p></div><div id=content><p>{LONG} 1</p><p>x</p></div><div class='comments'><p>{LONG} 2</p></div>", f"{LONG} 1\nx"),
        (f"<div><a href=x>one</a> <a href=y>two</a></div><div><p>Head</p><p>{LONG}</p><p>End.</p></div><div>© 2024 All rights reserved</div>", f"Head\n{LONG}\nEnd."),
        (f"<article><p>{LONG}</p><form><p>name <input></p></form><aside>x</aside><script>var t='</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>last</p><section class=comments><article>hi</article></section></article>", f"{LONG}\nlast"),
        (f"<article><header><h1>Title</h1></header><p>a\n\t b&nbsp;c</p><div class='cookie-notice'>ok?</div></article>", "Title\na b c"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
        ("<article><p title='a > b'>x</p></article>", "x"),
        ("<p>a < b and c<d", "a < b and c"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_long_text_beside_a_named_article():
    assert main_text(f"<article><p>teaser</p></article><div><p>{LONG} 1</p><p>{LONG} 2</p></div><p>x</p>") == f"teaser\n{LONG} 1\n{LONG} 2\nx"
    assert main_text(f"<p>short</p><article><p>{LONG}</p></article><p>12 likes</p>") == LONG


def test_names_of_parts_are_evidence_only():
    assert main_text(f"<div class='post-tags-free'><p>{LONG}</p><p>x</p></div>") == f"{LONG}\nx"
    assert main_text(f"<article><h1>T</h1><div class='legal'><p>{LONG}</p><p>y</p></div><p>z</p></article>") == f"T\n{LONG}\ny\nz"
    adverts = "".join(f"<div class=ad>Buy {i}</div>" for i in range(3))
    assert main_text(f"<p>{LONG}</p>{adverts}<p>Short closing line.</p>") == f"{LONG}\nShort closing line."
    assert main_text(f"<article><p>a</p><div class='legal'>Terms of use</div><p>{LONG}</p></article>") == f"a\n{LONG}"
    comments = "".join(f"<div><p>{LONG} {i}</p></div>" for i in range(30))
    assert main_text(f"<article><p>Text.</p></article><section id=comments>{comments}</section>") == "Text."


def plain_regions(masses, window, surge):
    """Brute force: lines whose windows hold something, in runs with a window of a surge."""
    sums = [sum(masses[i : i + window]) for i in range(len(masses))]
    runs = [r for r in "".join("x" if s else " " for s in sums).split(" ")]
    out, at = [], 0
    for r in runs:
        if r and max(sums[at : at + len(r)]) >= surge:
            out.append((at, at + len(r)))
        at += len(r) + 1
    return out


def test_surges_and_dives_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(2000):
        masses = [rnd.choice([0, 0, 0, 1, 10, 30, 70]) for _ in range(rnd.randint(0, 25))]
        window, surge = rnd.randint(1, 5), rnd.choice([1, 40, 60, 100])
        assert html_text.regions(masses, window, surge) == plain_regions(masses, window, surge)


def test_windows_decide_on_the_pages_of_the_test_table(spark, monkeypatch):
    """Without surges every line with a mass stays: all pages have other texts then."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    texts = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "regions", lambda masses: [(0, len(masses))])
    assert sum(a != main_text(p) for a, p in zip(texts, pages)) > len(pages) // 2


def test_long_and_broken_pages():
    for page in ("<" * 200_000, "<a " * 100_000, "<div>" * 20_000 + "x", "&amp;" * 100_000, "<!--" * 50_000, "<script>" * 20_000, "<a \"" * 50_000):
        main_text(page)
    assert len(main_text(f"<article>{'<p>word word</p>' * 50_000}</article>").split("\n")) == 50_000


def test_articles_of_the_test_table_are_whole(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in extract(table).collect()}
    for r in table.collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [" ".join(codes.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1|br)>", article)]
        assert found[r.page_id].text == "\n".join(b for b in blocks if b) and found[r.page_id].n_chars == len(found[r.page_id].text)


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (None, "u", "<article>a</article>", "x", "y"), (1, "u", "<article>b</article>", "x", "y")]
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, schema)).collect()) == [(0, "u", "a", 1), (1, "", "", 0), (1, "u", "b", 1)]
    assert extract(spark.createDataFrame([], schema)).count() == 0
