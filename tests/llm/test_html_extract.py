import html
import itertools
import random
import re

import numpy as np
import pytest

from covista.llm import mincut, queries
from covista.llm.html_extract import SIZE, blocks_of, extract, main_text

W = np.zeros(SIZE)


def cost(scores, edges, keep):
    return (sum(abs(s) for s, k in zip(scores, keep) if (s > 0) != k and s) +
            sum(c for a, b, c in edges if a != b and keep[a] != keep[b]))


@pytest.mark.parametrize("settle", [True, False])
def test_cut_is_minimal(settle):
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        scores = [rng.choice([0, rng.uniform(-2, 2), rng.uniform(-2, 2)]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1.5)) for _ in range(rng.randint(0, 12))]
        keep = mincut.labels(scores, edges) if settle else mincut.max_flow(scores, [e for e in edges if e[0] != e[1]])
        least = min(cost(scores, edges, k) for k in itertools.product([False, True], repeat=n))
        assert cost(scores, edges, keep) == pytest.approx(least, abs=1e-6)


def test_long_page_cut():
    rng = random.Random(1)
    scores = [rng.uniform(-1, 1) for _ in range(3000)]
    edges = [(i, i + 1, 0.6) for i in range(2999)]
    keep = mincut.labels(scores, edges)
    best = [0.0, 0.0]   # by dynamic programming over the chain
    for i, s in enumerate(scores):
        unary = [max(s, 0), max(-s, 0)]
        best = [unary[k] + (min(best[k], best[1 - k] + 0.6) if i else 0) for k in (0, 1)]
    assert cost(scores, edges, keep) == pytest.approx(min(best))


def test_query_takes_the_article(spark, sf):
    """The driver's pages: heading and paragraphs of the article, and nothing around it."""
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", article)
        texts = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", p))).split()) for p in parts]
        want[r.page_id] = "\n\n".join(t for t in texts if t)
    got = {r.page_id: r for r in queries.op5_html_main_text(spark, sf).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(set(want.values())) > 30


PAGE = """<body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies.</div><main><article><header><h1>The &amp; title</h1><p>By me</p></header>
<p>First&nbsp;para   with <i>words</i><br>and a break.<div class="ad-box"><p>Buy now!</p></div>
<ul><li>one<li>two</ul><form><p>Your name</p><button>Go</button></form><script>var a="<p>no</p>"</script>
<p hidden>secret</p><table><tr><td>a<td>b<tr><td>c</table><aside>Side</aside><section id="comments"><p>Nice one, says Bob.</p></section>
</article></main><div id="sidebar"><p>More things</p></div><footer>&copy; me</footer>"""


def test_parts_of_a_page():
    assert main_text(PAGE, W).split("\n\n") == ["The & title", "First para with words and a break.", "one", "two", "a b", "c"]


def test_smoothness_and_classifier_decide_unnamed_blocks(spark, sf):
    page = "<div><div><a href=a>Home</a></div><div><a href=b>About us</a></div></div><div>" + "".join(
        f"<p>This is a long sentence number {i}, which says something, and it goes on for a while. It ends here.</p>" for i in range(6)) + "</div>"
    from covista.llm.html_extract import train
    weights = train(spark.read.parquet(f"{sf}/pages.parquet"))
    text = main_text(page, weights)
    assert text.count("long sentence") == 6 and "About" not in text


def test_blocks_of_broken_markup():
    assert [b.text for b in blocks_of("a<b>c</div></p>d<p>e<p>f</b>g<!-- x --><![if y]><p>h")] == ["acd", "e", "fg", "h"]
    assert blocks_of("<script>never closed <p>x") == [] and blocks_of("") == []


ROWS = [(1, "u", None), (2, None, ""), (None, "v", "<p>x</p>"), (3, "w", "<article>" + "<p>word &lt; word</p>" * 20_000 + "</article>"),
        (4, "u", PAGE), (4, "u", PAGE), (5, "u", "<nav>only</nav>")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, u, h, "t", 7) for i, u, h in ROWS], "page_id bigint, url string, html string, text string, n_chars int")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {(r.page_id, r.url): r for r in got.collect()}
    assert got.count() == len(ROWS) and rows[(1, "u")].text == "" and rows[(2, None)].n_chars == 0 and rows[(5, "u")].text == ""
    assert rows[(3, "w")].text.count("word < word") == 20_000
    assert extract(df.limit(0)).collect() == []


def test_wrappers_of_a_whole_page_are_not_boilerplate():
    text = "".join(f"<p>Sentence number {i} of the article, which goes on for a while.</p>" for i in range(8))
    form = f"<body><form id=aspnetform><nav><a href=x>Home</a></nav><article>{text}</article><footer>me</footer></form>"
    assert main_text(form, W).count("Sentence") == 8 and "Home" not in main_text(form, W) and "me" not in main_text(form, W).split()
    assert main_text(f'<body><div class="content no-sidebar">{text}</div><div class=footer>me</div>', W).count("\n\n") == 7
    comments = f"<article><p>Short.</p></article><section class=comments>{text}</section><form><p>Your name</p></form>"
    assert main_text(comments, W) == "Short."


SENTENCE = "This is a long sentence, which says something, and it goes on for a while. It ends here."
STORY = "".join(f"<p>{SENTENCE} {i}.</p>" for i in range(5))
KEPT = [f"{SENTENCE} {i}." for i in range(5)]
BAD = f"<p>Not this: {SENTENCE}</p>"


@pytest.fixture(scope="module")
def weights(spark, sf):
    from covista.llm.html_extract import train
    return train(spark.read.parquet(f"{sf}/pages.parquet"))


@pytest.mark.parametrize("page, want", [
    (f'<article>{STORY}<div class="ad">{BAD}</div></article>', KEPT),
    (f"<article>{STORY}<aside>{BAD}</aside></article>", KEPT),
    (f"<article>{STORY}<section id=comments>{BAD}</section></article>", KEPT),
    (f"<article>{STORY}</article><footer>{BAD}</footer>", KEPT),
    (f"<main>{STORY}<form>{BAD}</form></main>", KEPT),
    (f'<div class="post"><div class="post-header"><h1>Ti</h1></div>{STORY}</div>', ["Ti", *KEPT]),
    (f"<h1>Ti</h1>{STORY}<div class=comments>" + f"<div><h4>Bob</h4>{BAD}</div>" * 12 + "</div>", ["Ti", *KEPT]),
    (f'<div class="content has-sidebar"><h1>Ti</h1>{STORY}</div><div class=sidebar>{BAD}</div>', ["Ti", *KEPT]),
    (f"<form id=f><nav>{BAD}</nav><h1>Ti</h1>{STORY}<div role=search>{BAD}</div></form>", ["Ti", *KEPT]),
])
def test_named_boilerplate_never_stays(weights, page, want):
    assert main_text(page, weights).split("\n\n") == want


def test_the_cut_finds_the_article_without_names(spark, sf, weights, monkeypatch):
    """The driver's pages with class, id and role taken away and page parts turned into div."""
    flows, real = [], mincut.max_flow
    monkeypatch.setattr(mincut, "max_flow", lambda *a: flows.append(1) or real(*a))
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    found = 0
    for r in pages:
        page = re.sub(r'\s(class|id|role)="[^"]*"', "", r.html)
        page = re.sub(r"<(/?)(article|nav|aside|footer|header|form)\b", r"<\1div", page)
        found += main_text(page, weights) == main_text(r.html, weights)
    assert found >= 0.9 * len(pages) and len(flows) >= 0.9 * len(pages)


def test_deep_pages_take_linear_time():
    import time
    start = time.time()
    assert main_text("<div>x " * 10_000, W) == "" and main_text("<div>x </p></section>" * 10_000, W) == ""
    assert main_text("<article>" + "<div>x " * 10_000, W).count("x") == 10_000
    assert time.time() - start < 10


def test_pages_without_an_id_do_not_fill_the_sample(spark, monkeypatch):
    from covista.llm import html_extract
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
        yield from ()

    monkeypatch.setattr(html_extract, "_train", count)
    df = spark.range(20_000).selectExpr("cast(null as bigint) page_id", "concat('<p>', if(id % 3 = 0, 0, id), '</p>') html")
    html_extract.train(df, sample_pages=500)
    assert 0 < seen.value < 1000
