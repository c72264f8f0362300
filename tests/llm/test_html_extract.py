import random
import re
import time
from html import unescape

import pytest

from matchloom.llm import html_extract as he
from matchloom.llm.html_extract import extract, extract_pages

LONG = "This is a paragraph of ordinary article text that is long enough to count as one."


LINKS = "<ul><li><a href=/1>Home page</a><li><a href=/2>All our products</a><li><a href=/3>Contact and imprint</a></ul>"
TWO = f"<p>{LONG}</p><p>{LONG}</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        # link lists without any name or mark go by their weight, in and outside main parts
        (f"{LINKS}{TWO}{LINKS}", f"{LONG} {LONG}"),
        (f"<article>{TWO}{LINKS}</article>", f"{LONG} {LONG}"),
        (f"<article>{TWO}<p>See <a href=/x>the docs</a> for more.</p></article>", f"{LONG} {LONG} See the docs for more."),
        (f"<p><a href=/a>One</a></p><h1>Head</h1>{TWO}<p>Short end.</p>", f"Head {LONG} {LONG} Short end."),
        # short text beside skipped blocks stays
        (f"<nav>m</nav>{TWO}<nav>a</nav><nav>b</nav><nav>c</nav><p>Last short paragraph.</p>", f"{LONG} {LONG} Last short paragraph."),
        (f"<article><h1>Head</h1><p>a</p><div class=ad>buy now</div><p>b</p></article>", "Head a b"),
        # names: the last word decides, or all do
        ("<article><div class='post-header'><h1>Head</h1></div><p>Body text</p><p class='share-price'>Share price fell</p></article>", "Head Body text Share price fell"),
        (f"<div class='layout has-sidebar'>{TWO}</div>", f"{LONG} {LONG}"),
        (f"<div class='content no-ads'>{TWO}</div>", f"{LONG} {LONG}"),
        (f"{TWO}<div class='post-comments'>{TWO}</div>", f"{LONG} {LONG}"),
        (f"{TWO}<div id=relatedPosts>{TWO}</div>", f"{LONG} {LONG}"),
        (f"<article>{TWO}<section class=comments><article class=comment>{TWO}</article></section></article>", f"{LONG} {LONG}"),
        (f"<article>{TWO}<div class='ad-slot'>Buy our new and improved product today.</div>{TWO}</article>", " ".join([LONG] * 4)),
        (f"<article>{TWO}<div id=cookie-banner>We use cookies on this page.</div></article>", f"{LONG} {LONG}"),
        # a main part in a form or in page furniture, and a form that holds the page
        (f"<form><div><main>{TWO}</main></div><input><button>go</button></form>", f"{LONG} {LONG}"),
        (f"<form>{TWO}<p>More.</p></form>", f"{LONG} {LONG} More."),
        (f"{TWO}{TWO}<form>Your name and address please</form>", " ".join([LONG] * 4)),
        (f"<div class=modal><article>{TWO}</article></div>", f"{LONG} {LONG}"),
        # roles, headers, nested parts
        (f"<div role=banner>Site</div><div role=main>{TWO}</div><div role=contentinfo>c</div>", f"{LONG} {LONG}"),
        (f"<header><h2>Site name</h2></header><article><header><h1>Head</h1></header>{TWO}</article>", f"Head {LONG} {LONG}"),
        (f"<main><article><h1>A</h1>{TWO}</article><aside>{TWO}</aside></main>", f"A {LONG} {LONG}"),
        (f"<div itemprop=articleBody>{TWO}</div><div>{LONG[:40]}</div>", f"{LONG} {LONG}"),
        (f"<article>{TWO}</article><div>Unmarked note beside it.</div><article><p>Second one.</p></article>", f"{LONG} {LONG} Second one."),
        # outside a main part only what is dense enough to make up for it
        (f"<div><p>{LONG * 6}</p><p>{LONG * 6}</p></div><main><h1>Head</h1></main>", f"{LONG * 6} {LONG * 6} Head"),
        # broken and unusual markup
        (f"<article><p><b>{LONG}<br><p>Next &amp;amp; last</article>", f"{LONG} Next &amp; last"),
        (f"<article><table><tr><td>{LONG}<td>cell<tr><td>row</table></article>", f"{LONG} cell row"),
        (f"<article><p>{LONG}</p></div></span></article><footer>f</footer>", LONG),
        (f"<article><p title='a > b' data-x=\"<p>no</p>\">{LONG}</p></article>", LONG),
        (f"<article>{TWO}<p class=\"open>lost quote</p><p>x</p></article>", f"{LONG} {LONG} lost quote x"),
        (f"<article><dl><dt>term<dd>{LONG}</dl><pre>a\n  b</pre><blockquote>{LONG}</blockquote></article>", f"term {LONG} a b {LONG}"),
        (f"<ARTICLE><P>{LONG}</P><![CDATA[raw <b>]]></ARTICLE>", f"{LONG} raw <b>"),
        (f"<article><svg><text>no</text></svg><noscript>no</noscript><p>{LONG}</p><textarea>no</textarea></article>", LONG),
    ],
)
def test_varied_pages(page, want):
    assert extract(page) == want


def test_blocks_decide():
    """With blocks switched off, link lists and notes come in: the distribution takes them out."""
    for page in (f"{LINKS}{TWO}{LINKS}", f"<article>{TWO}{LINKS}</article>", f"<article>{TWO}</article><div>Note.</div>"):
        assert extract(page) == f"{LONG} {LONG}" != extract(page, width=0)


def test_surge_and_dive_against_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        w = [rng.choice([0, rng.randrange(-100, 100)]) for _ in range(rng.randrange(30))]
        width, bar = rng.choice([1, 2, 3, 5]), rng.randrange(0, 90)
        back = (width - 1) // 2
        values = [sum(w[j] for j in range(i - back, i - back + width) if 0 <= j < len(w)) for i in range(len(w))]
        assert he.blocks(w, width) == values
        # a line is kept if all values from it to some surge are positive
        kept = [any(values[s] > bar and all(values[j] > 0 for j in range(min(i, s), max(i, s) + 1)) for s in range(len(w))) for i in range(len(w))]
        got = [False] * len(w)
        for a, b in he.stretches(values, bar):
            got[a:b] = [True] * (b - a)
        assert got == kept


@pytest.mark.parametrize("piece", ["<a ", '<a b="', '<a b=">', "<div>", "<p><table><div>", "</b>", "<!--", "<", "&", "<li><div>", "<i></div>"])
def test_broken_markup_takes_linear_time(piece):
    n = 2_000_000 // len(piece) // 4
    began = time.process_time()
    extract(piece * n)
    small = time.process_time() - began
    began = time.process_time()
    extract(piece * n * 4)
    assert time.process_time() - began < 10 * small + 1


def test_articles_lose_no_text(spark, sf_dir):
    """Pages of the table: all text of the marked article, by a plain reading of its markup, and nothing else."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        words = unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split()
        assert extract(r["html"]).split() == words


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("no markup &amp; one  line", "no markup & one line"),
        (f"<nav><a>Home</a></nav><article><h1>T</h1><p>{LONG}<br>x<p>y</article><footer>&copy; z</footer>", f"T {LONG} x y"),
        (f"<div class='ad'>buy</div><div id=header>Site</div><div>{LONG}</div><div class='comment-list'><p>{LONG}</div>", LONG),
        (f"<body><div class=sidebar>{LONG}</div><main><p>a</p></main>", "a"),
        (f"<article><header><h1>Head</h1></header><p>{LONG}</p><aside>n</aside><form>f<input></form><p>t</p></article>", f"Head {LONG} t"),
        (f"<p>{LONG}</p><script>if (a < b) '<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>&lt;b&gt; 1 < 2 &#233;</p>", f"{LONG} <b> 1 < 2 é"),
        (f"<article><p>in<b>li</b>ne\n\t x</p><ul><li>one<li>two</ul><div class=notice>n</div></article>", "inline x one two"),
        (f"<article><p>{LONG}", LONG),
        ("<article></article>", ""),
        (f"<p hidden>h</p><p style='display:none'>d</p><p>{LONG}</p>", LONG),
    ],
)
def test_cases(page, want):
    assert extract(page) == want


def test_long_page():
    assert extract("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>") == " ".join([LONG] * 3000)


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", 5), (1, None, None, 5), (None, "u", "", 5)], "page_id bigint, url string, html string, text int")
    got = sorted(map(str, (tuple(r) for r in extract_pages(rows).collect())))
    assert got == sorted(map(str, [(1, "u", LONG, len(LONG)), (1, None, "", 0), (None, "u", "", 0)]))
    assert extract_pages(rows.limit(0)).count() == 0


def test_pages_keep_their_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got.values())
