from __future__ import annotations

import random
import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from labelscope.llm import cover_tree, embedding_dedup, html_text
from labelscope.llm.components import smallest_reachable


def brute(ids, x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    node, low = smallest_reachable(ids[i], ids[j])
    comp = dict(zip(node.tolist(), low.tolist(), strict=True))
    return {int(k): (int(d), comp.get(int(k), int(k))) for k, d in zip(ids, near.sum(1), strict=True)}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    parts = [rng.normal(size=(60, 16))] + [c + rng.normal(size=(n, 16)) * s for c, n, s in zip(centres, [3, 5, 40, 90, 7, 2, 20, 1, 30, 4, 60, 8], [0.02, 0.3, 0.1, 0.35, 0.2, 0.01, 0.4, 0.1, 0.05, 0.25, 0.3, 0.15], strict=True)]
    x = np.concatenate(parts).astype(np.float32).astype(float)
    return np.arange(len(x)) * 3, x


@pytest.mark.parametrize("block", [1 << 20, 64 * 16 * 8])
def test_near_duplicates_equal_brute_force(spark, clustered, block):
    ids, x = clustered
    rows = [(int(i), v.tolist(), "label", 0) for i, v in zip(ids, x, strict=True)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string, dim int"), block_bytes=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute(ids, x)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
        (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e30, 1e20]),
    ]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 4, 1), (2, 4, 1), (2, 4, 1), (3, 4, 1), (12, 4, 1), *[(i, 0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11)], (None, 0, None)], key=str
    )
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tree_is_nested_and_covers(clustered):
    _, x = clustered
    u = x / np.linalg.norm(x, axis=1)[:, None]
    path = cover_tree.paths(u)
    for level, radius in enumerate(cover_tree.RADII):
        own = path[:, level]
        assert (path[own, level] == own).all()
        if level + 1 < len(cover_tree.RADII):
            assert (path[own, level + 1] == own).all()  # a node's centre is a node of the finer level
    finest = path[:, -1]
    assert (np.sqrt(np.maximum(0, 2 - 2 * (u * u[finest]).sum(1))) <= cover_tree.RADII[-1] + 1e-3).all()


def test_one_dense_cluster_over_several_blocks(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=16)
    x = np.concatenate([middle + rng.normal(0, 0.25, (300, 16)), -middle + rng.normal(0, 0.02, (80, 16)), rng.normal(size=(60, 16))])
    ids = rng.permutation(len(x)) + 5
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, block_bytes=16 * 8 * 20).collect()}
    assert got == brute(ids, x)


def test_cells_far_apart_are_not_paired():
    pivots = {2: np.array([[1.0, 0.0], [-1.0, 0.0], [0.9986, 0.0523]]), 3: np.eye(3)}
    cells = [{"dim": 2, "cell": c, "radius": 0.1} for c in range(3)] + [{"dim": 3, "cell": 0, "radius": 0.0}]
    got = embedding_dedup.near_cells(cells, pivots, 0.2)
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(2, 0, 0), (2, 0, 2), (2, 1, 1), (2, 2, 2), (3, 0, 0)]


ARTICLE = "<article><h1>A  title &amp; more</h1><p>Some <b>bold</b>\n text.<br>Second line</p><p>x</p></article>"


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


WANT = "A title & more\nSome bold text.\nSecond line\nx"


@pytest.mark.parametrize(
    "before",
    [
        "", "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<header><div>Site name</div></header>", "<!-- <p>gone</p> --><div class=\"ad\">Buy</div>", "<div id='cookie-notice'><p>We use cookies</p></div>",
        "<aside><p>Related things that are long enough to surge past the threshold of the distribution, really.</p></aside>", "<form><label>Mail</label><input name=q></form>", "<div class='sidebar'><div>x</div><p>y</p></div>",
    ],
)
@pytest.mark.parametrize("after", ["", "<footer>&copy; me</footer>", "<div class='comments'><p>First!</p><p>A long comment by a reader that goes on for quite a while, on and on and on.</p></div>", "<section id=comments><p>c</p></section><script>x</script>"])
def test_article_is_kept_and_the_frame_goes(before, after):
    assert html_text.main_text(page(before + ARTICLE + after)) == WANT
    assert html_text.main_text(page(before + ARTICLE.replace("article>", "main>") + after)) == WANT


def test_marked_blocks_inside_an_article_go():
    body = "<article><header><h1>T</h1></header><p>One</p><div class='ad-slot'>ad</div><p>Two</p><aside>no</aside><nav>toc</nav><div class='share'><a>f</a></div><p>Three</p></article>"
    assert html_text.main_text(page(body)) == "T\nOne\nTwo\nThree"


def test_pages_without_article_go_by_the_distribution():
    text = "A paragraph of running text that is long enough to stand out among the lines around it. " * 2
    body = f"<div><a href=1>one</a></div><div><a href=2>two</a></div><nav>menu</nav><div><p>{text}</p><p>Short.</p><p>{text}</p></div><footer>f</footer><p>tail</p>"
    assert html_text.main_text(page(body)) == "\n".join([text.strip(), "Short.", text.strip()])


def test_paragraphs_that_are_notices_end_with_the_paragraph():
    assert html_text.main_text(page("<article><p class=notice>Old browser<p>One</p><ul><li class='ad'>buy<li>Item</ul><p>Two</article>")) == "One\nItem\nTwo"


def test_comments_marked_up_as_articles_go():
    body = "<article><p>Body</p></article><ol class='comment-list'><li><article class='comment-body'><p>First</p></article></li></ol><article class='related'><p>More</p></article>"
    assert html_text.main_text(page(body)) == "Body"


def test_own_header_of_a_page_without_article():
    text = "A paragraph of running text that is long enough to stand out among the lines around it. "
    assert html_text.main_text(page(f"<div class='site-header'>Site</div><div class='entry-header'><h1>Title</h1></div><p>{text}</p>")) == f"Title\n{text.strip()}"


def test_odd_html():
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("just text &lt; here") == "just text < here"
    assert html_text.main_text("<article><p>open <i>tags <p>2 < 3 and &am</article>") == "open tags\n2 < 3 and &am"
    assert html_text.main_text("<nav>never closed <article><p>body</p></article>") == "body"
    assert html_text.main_text("<article><p>a</p><script>cut off") == "a"
    assert html_text.main_text("<article><p title='it's>'>quote</p></article>").endswith("quote")
    assert html_text.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


TEXT = "A paragraph of running text that is long enough to stand out among the lines around it. "


@pytest.mark.parametrize("named", ["has-sidebar", "col no-ads", "with-footer", "share", "comments-page", "legal"])
def test_a_block_that_holds_the_text_is_text_whatever_its_name(named):
    body = f"<div class='site-nav'><a href=1>Home</a></div><div class='{named}'><h1>Title</h1><p>{TEXT}</p><p>Short.</p></div><div class='ad'>Buy</div>"
    assert html_text.main_text(page(body)) == f"Title\n{TEXT.strip()}\nShort."
    body = f"<div class='{named}'><nav><a href=1>Home</a></nav><article><p>{TEXT}</p><p>Short.</p></article><footer>f</footer></div>"
    assert html_text.main_text(page(body)) == f"{TEXT.strip()}\nShort."


def test_own_blocks_links_and_mains_of_links():
    body = f"<main><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></main><div><h1>Title</h1><p>{TEXT}</p></div>"
    assert html_text.main_text(page(body)) == f"Title\n{TEXT.strip()}"
    body = f"<article><p>{TEXT}</p><div class='entry legal'><p>Terms of the story.</p></div><p><a href=3>See this</a></p><p>End.</p></article>"
    assert html_text.main_text(page(body)) == f"{TEXT.strip()}\nTerms of the story.\nSee this\nEnd."
    body = f"<article><p>Body.</p><div class='comments'><p>{TEXT}</p></div><p>End.</p></article><p>{TEXT}</p>"
    assert html_text.main_text(page(body)) == "Body.\nEnd."
    assert html_text.main_text(page(f"<article><h1></h1><p></p></article><div class='ad'>{TEXT}</div><footer>{TEXT}</footer>")) == ""
    long = TEXT * 2
    assert html_text.main_text(page(f"<article><p>{long}</p><div class='comments'><p>{long * 3}</p></div></article>")) == long.strip()


@pytest.mark.parametrize(
    ("named", "stays"),
    [
        ("sponsored-content", False), ("newsletter-content", False), ("sidebar-content", False), ("post-comments", False), ("content sponsored", False), ("postComments", False), ("entry-content related", False),
        ("story ad", False), ("article-share", False), ("entry-header", True), ("post-content widget", True), ("entry comments-open", True), ("content ad-free", True), ("post has-comments", True), ("story-body", True),
    ],
)
def test_a_mark_beside_an_own_word(named, stays):
    body = f"<p>{TEXT}</p><div class='{named}'><p>{TEXT}X</p></div><p>End.</p>"
    want = f"{TEXT.strip()}\n" + f"{TEXT}X\n" * stays + "End."
    assert html_text.main_text(page(f"<article>{body}</article>")) == want
    assert html_text.main_text(page(f"<main>{body}</main>")) == want
    assert html_text.main_text(page(f"<div>{body}</div>")) == want


@pytest.mark.parametrize("n", [1, 3, 4, 50])
def test_an_article_loses_no_paragraph_of_links(n):
    links = "".join(f"<p><a href='{i}'>Link {i}</a></p>" for i in range(n))
    got = "".join(f"Link {i}\n" for i in range(n))
    for element in ("article", "main"):
        for before, after in ((links, ""), ("", links), (links, links)):
            body = f"<{element}>{before}<p>{TEXT}</p>{links}<div class=ad><p>b</p><p>b</p><p>b</p><p>b</p></div><p>End.</p>{after}</{element}>"
            want = got * bool(before) + f"{TEXT.strip()}\n" + got + "End.\n" + got * bool(after)
            assert html_text.main_text(page(body)) == want.strip()
    menu = "<ul>" + "<li><a href=1>Home</a></li>" * (n + 3) + "</ul>"
    assert html_text.main_text(page(f"<main>{menu}<article><h1>T</h1><p>{TEXT}</p></article></main>")) == f"T\n{TEXT.strip()}"


class Plain(HTMLParser):
    """Lines of a well-formed page: (text, characters in links, inside an article, in a named or frame block)."""

    def __init__(self):
        super().__init__()
        self.stack, self.lines, self.parts, self.linked = [], [], [], 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            frame = any(n in ("nav", "footer") or c in ("ad", "comments", "post-comments", "sidebar-content", "sponsored-content") for n, c in self.stack)
            self.lines.append((text, self.linked, any(n == "article" for n, _ in self.stack), frame))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "a", "script", "style", "title", "meta"):
            self.stack += [(tag, "")] if tag != "meta" else []
            return
        self.flush()
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
            self.stack.pop()
        if tag in ("nav", "footer", "article"):
            self.lines += [("", 0, False, False)] * 3
        if tag != "br":
            self.stack.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "script", "style", "title"):
            self.flush()
        if tag == "article":
            self.lines += [("", 0, False, False)] * 3
        while any(n == tag for n, _ in self.stack) and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if not {"script", "style", "title"} & {n for n, _ in self.stack}:
            self.parts.append(data)
            self.linked += len(data) if any(n == "a" for n, _ in self.stack) else 0


def brute_main_text(html):
    parser = Plain()
    parser.feed(html)
    parser.flush()
    weight = []
    for text, linked, inside, frame in parser.lines:
        own = len(text) - linked
        weight.append(0 if frame or own <= 0 and not (text and inside) else own + 80 if inside else own * 0.05)
    n = len(weight)
    up = [sum(weight[max(0, i - 2) : i + 1]) > 0 and sum(weight[i : i + 3]) > 0 for i in range(n)]
    out, i = [], 0
    while i < n:
        j = i
        while j < n and up[j]:
            j += 1
        if any(sum(weight[k : k + 3]) >= 80 for k in range(i, j)):
            out += [text for text, _, _, frame in parser.lines[i:j] if text and not frame]
        i = max(j, i + 1)
    return "\n".join(out)


def test_all_pages_equal_a_plain_distribution():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert len(pages) >= 250
    for row in pages:
        got = html_text.main_text(row["html"])
        assert got == brute_main_text(row["html"] or ""), row["url"]
        for at in re.findall(r"<article>(.*?)</article>", row["html"] or "", re.S):
            assert "".join(got.split()) == "".join(unescape(re.sub("<[^>]*>", "", at)).split())


def test_made_pages_equal_a_plain_distribution():
    rng = random.Random(6)
    for _ in range(300):
        part = lambda: rng.choice(
            [f"<p>{TEXT * rng.randint(1, 2)}</p>", "<p>Short.</p>", "<p><a href='x'>A link alone</a></p>", "<ul><li><a href='y'>One</a></li><li>two</li></ul>"]
            + [f"<div class='{name}'><p>{rng.choice((TEXT, 'Buy.'))}</p><p>x</p></div>" for name in ("ad", "comments", "post-comments", "sidebar-content", "sponsored-content")]
        )
        body = f"<nav><p>{TEXT}</p></nav><article><h1>Title</h1><p>{TEXT}</p>{''.join(part() for _ in range(rng.randint(0, 12)))}</article><footer><p>{TEXT}</p></footer>"
        assert html_text.main_text(page(body)) == brute_main_text(page(body)), body


def test_page_rows(spark):
    rows = [(1, "u", page(ARTICLE), "x"), (1, "u", page(ARTICLE), "x"), (2, None, None, "y"), (None, "v", "", "z")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect() if r["page_id"])
    assert got == [(1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0)]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
