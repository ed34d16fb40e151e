"""Main text of pages, centroids and hard negatives: brute force, held-out layouts and awkward rows."""

import hashlib
import html
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from blockrank.llm import boosting, centroids, hard_negatives, html_extract
from blockrank.llm.html_tree import parse

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, n_chars int, tag string"


@pytest.fixture(scope="module")
def sample():
    return pq.read_table(f"{SMALL}/pages.parquet").to_pydict()["html"]


@pytest.fixture(scope="module")
def model(sample):
    return html_extract.train(sample)


def article(source):
    """The text between the article's tags, block by block."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)


def runs(source):
    page = parse(source)
    return [(page.tag[p], t) for p, t in zip(page.parent, page.text, strict=True) if t]


def test_trees_of_odd_pages():
    assert runs("") == runs("<") == [] or runs("<") == [("html", "<")]
    assert runs("<p>a&amp;b &lt;i&gt;&nbsp; c\n d<br>e<p>f") == [("p", "a&b <i> c d e"), ("p", "f")]
    assert runs("<script>var t='</p><p>no';</script><p>yes<!-- no > --> too</p><style>p{}</style>") == [("p", "yes too")]
    assert runs("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]
    assert runs("<table><tr><td>1<td>2<tr><td>3</table>") == [("td", "1"), ("td", "2"), ("td", "3")]
    assert runs("<p title=it's>a</p><p title='x>y'>b</p></div></p>c") == [("p", "a"), ("p", "b"), ("html", "c")]
    assert runs("2 < 3 <title>no</title> & <select><option>no</select>4") == [("html", "2 < 3 & 4")]
    deep = parse("<div>" * 20_000 + "x")
    assert deep.depth[-1] == 20_001 and html_extract.decode(html_extract.Forest([deep]), np.ones(len(deep.tag))) == ["x"]
    page = parse('<p class="Ad-box sideBar">one <a href=x>two</a></p>')
    assert page.tokens[1] == ("ad", "box", "side", "bar") and page.linked[-1] == 3


def test_decoding_equals_brute_force():
    """The greatest sum over all sets of nodes that are closed under parents."""
    rng = random.Random(3)
    for _ in range(200):
        source = "".join(rng.choice(("<div>", "</div>", "<p>x", "<p>y", "z", "<section>")) for _ in range(7))
        page = parse(source)
        score = np.array([rng.choice((-2, -1, 1, 3)) * rng.random() for _ in page.tag])
        best, want = 0.0, []
        for size in range(1, len(page.tag) + 1):
            for chosen in itertools.combinations(range(len(page.tag)), size):
                s = set(chosen)
                if all(page.parent[i] < 0 or page.parent[i] in s for i in s) and sum(score[list(chosen)]) > best:
                    best, want = sum(score[list(chosen)]), [page.text[i] for i in chosen if page.text[i]]
        assert html_extract.decode(html_extract.Forest([page]), score) == ["\n".join(want)]


def test_boosting_learns_a_rule_with_a_condition():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 6)).astype(np.float32)
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.3)).astype(float)
    trees = boosting.fit(x[:3000], y[:3000], np.ones(3000))
    assert ((trees.scores(x[3000:]) > 0) == (y[3000:] > 0.5)).mean() > 0.98
    assert (boosting.fit(x[:50], np.zeros(50), np.ones(50)).scores(x) < 0).all()


def test_main_text_of_the_tables_pages(spark, model):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, model).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_main_text_of_unseen_layouts(model, sample):
    """Layouts of another seed: precision and recall of runs of text."""
    texts = [t for h in sample[25:] for t in parse(h).text if t]
    rng, hit, said, there = random.Random(77), 0, 0, 0
    for _ in range(150):
        source = html_extract.Layout(rng, texts).page()
        page = parse(source)
        want = [t for t, y in zip(page.text, html_extract._by_marks(page), strict=True) if t and y]
        got = [t for t in model.texts([page])[0].split("\n") if t]
        hit += sum(min(got.count(t), want.count(t)) for t in set(got))
        said, there = said + len(got), there + len(want)
    assert hit / said > 0.93 and hit / there > 0.93


def test_main_text_of_written_pages(model):
    """A page with all the parts that are no main text, with and without landmarks."""
    body = "".join(f"<p>This is paragraph {i} of the story, and it has some words, as stories do.</p>" for i in range(6))
    noise = {
        "menu": '<nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">News</a></li></ul></nav>',
        "notice": '<div class="cookie-notice"><p>We use cookies to give you the best pages.</p><button>OK</button></div>',
        "advert": '<div class="ad">Buy this thing now, it is cheap.</div>',
        "form": '<form class="newsletter"><label>Your mail</label><input name=m><button>Send</button></form>',
        "side": '<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/x">One thing</a></li><li><a href="/y">Another thing</a></li></ul></aside>',
        "comments": '<section class="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with this story at all, sorry.</p></div><div class="comment"><p>Well written, thank you.</p></div></section>',
        "footer": '<footer class="footer">&copy; 2024 somebody, all rights reserved</footer>',
    }
    want = "The title\n" + "\n".join(f"This is paragraph {i} of the story, and it has some words, as stories do." for i in range(6))
    for tag, name in (("article", ""), ("div", ' class="post-content"'), ("main", ' id="content"')):
        source = f"<html><head><title>T</title></head><body>{noise['notice']}{noise['menu']}{noise['advert']}<div class='wrapper'><{tag}{name}><h1>The title</h1>{body}</{tag}>{noise['comments']}{noise['side']}</div>{noise['form']}{noise['footer']}</body></html>"
        assert model.texts([parse(source)])[0] == want, tag


def test_main_text_of_awkward_rows(spark, model, sample):
    long = "<article><p>" + "a word and more, " * 200_000 + "</article>"
    rows = [(1, "u", None, "t", 1, "x"), (None, None, "", None, None, None), (2, "u", sample[0], "t", 1, "x"), (2, "u", sample[0], "t", 1, "x"), (3, "u", "<nav><a href=x>menu</a></nav>", "t", 1, "x"), (4, "u", long, "", 0, "")]
    got = html_extract.extract(spark.createDataFrame(rows, PAGES), model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == "" and by[None].text == "" and by[1].n_chars == 0 and by[3].text == ""
    assert by[4].n_chars == len("a word and more, " * 200_000) - 1
    assert sum(r.page_id == 2 and r.text == article(sample[0]) for r in got) == 2
    empty = spark.createDataFrame([], PAGES)
    assert html_extract.extract(empty, model).count() == 0
    assert html_extract.train([], layouts=60).texts([parse("")]) == [""]


# centroids


VECTORS = "vec_id long, embedding array<float>, label int, q string, cluster int, row long"


def lloyd(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:k]
    cents = [list(q) for _, q in starts]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    place = lambda q: min(range(len(cents)), key=lambda c: (far(q, cents[c]), c))
    for _ in range(rounds):
        at = [place(q) for _, q in kept]
        for c in range(len(cents)):
            own = [q for (_, q), a in zip(kept, at, strict=True) if a == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = [(i, (c := place(q)), far(q, cents[c])) for i, q in kept]
    sums = {c: sum(d for _, b, d in out if b == c) for _, c, _ in out}
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def vector_rows(spark, rows, labels=None):
    return spark.createDataFrame([(i, v, labels[n] if labels else 1, "q", 7, 5) for n, (i, v) in enumerate(rows)], VECTORS)


def test_centroids_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.choice((-1, 0, 0.5)) + rng.random() / 9 for _ in range(4)] for _ in range(12)]
    rows = [(i, [x + rng.choice((0, 0, 0.3)) for x in rng.choice(base)]) for i in range(300)] + [(1000 + i, base[0]) for i in range(400)]
    rows += [(i, v) for i, v in rows[:5]] + [(None, base[1]), (None, base[1]), (2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (2003, [float("inf"), 0.0, 0.0, 0.0]), (2004, [1.0]), (2005, [])]
    got = centroids.cluster_vectors(vector_rows(spark, rows), k=7, rounds=3, dims=4)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows, 7, 3, 4)
    few = [(1, base[0]), (2, base[0]), (3, base[1])]
    assert sorted(map(tuple, centroids.cluster_vectors(vector_rows(spark, few), k=7, rounds=2, dims=4).collect()), key=repr) == lloyd(few, 7, 2, 4)
    assert centroids.cluster_vectors(vector_rows(spark, []), dims=4).count() == 0
    huge = [(1, [3e38, -3e38, 0.0, 0.0]), (2, [0.0] * 4), (3, [1e6, 0.0, 0.0, 0.0])]
    assert centroids.cluster_vectors(vector_rows(spark, huge), k=2, rounds=2, dims=4).count() == 3


def test_nearest_is_exact_in_both_arithmetics():
    rng = np.random.default_rng(5)
    for top in (100, 1 << 27):
        v, c = rng.integers(-top, top, (50, 6)), rng.integers(-top, top, (9, 6))
        c[3] = c[1]
        best, far = centroids.nearest(v, c)
        for i in range(50):
            all_ = [sum((int(a) - int(b)) ** 2 for a, b in zip(v[i], x, strict=True)) for x in c]
            assert far[i] == min(all_) and best[i] == all_.index(min(all_))


# hard negatives


def mined(rows):
    """rows (vec_id, label, vector) in the index's order, by the definition."""
    kept = []
    for n, (i, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v], n))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    order = lambda a: lambda b: (-score(a, b), b[0] is None, b[0] or 0, b[3])
    for a in kept:
        if a[0] is not None and a[0] % 50 == 0:
            for p in sorted((b for b in kept if b[1] == a[1] and b[3] != a[3]), key=order(a))[:5]:
                s = score(a, p)
                hits = sorted((b for b in kept if b[1] != a[1] and 50 * s <= 100 * score(a, b) <= 95 * s), key=order(a))[:3]
                out += [(a[0], p[0], k + 1, b[0], s, score(a, b)) for k, b in enumerate(hits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(hard_negatives, "ROW_CELL", 150)
    monkeypatch.setattr(hard_negatives, "ANCHOR_CELL", 4)
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(4), [x + rng.gauss(0, 0.6) for x in rng.choice(base)]) for i in range(400)]
    rows += [(1000 + i, 2, [0.5, 0.25, 0.0, 0.0, 0.5, 1.0]) for i in range(60)]  # one vector often: ties
    rows += [(50, 1, rows[50][2]), (None, 2, base[0]), (None, 3, base[0]), (3000, None, base[0]), (3001, 1, None), (3050, 1, [1.0, None]), (3100, 2, [float("nan")]), (3150, 1, []), (3200, 3, [1.0]), (3250, 2, [-x for x in base[0]]), (3300, 9, base[0])]
    table = vector_rows(spark, [(i, v) for i, _, v in rows], [x for _, x, _ in rows]).coalesce(1)
    got = sorted(map(tuple, hard_negatives.hard_negatives(table).collect()), key=repr)
    want = mined(rows)
    assert len(want) > 50 and got == want


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(vector_rows(spark, [])).count() == 0
    alone = vector_rows(spark, [(50, [1.0, 2.0]), (51, [1.0, 0.0])], [1, 2])
    assert hard_negatives.hard_negatives(alone).count() == 0


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(8)
    values = rng.integers(-200, 200, (500, 7))
    books = hard_negatives.codewords(np.hstack([values[:100], np.zeros((100, 0), int)]))
    import pyarrow as pa

    codes, left = hard_negatives.encode(values, books)
    table = pa.table({"row": np.arange(500), "id": np.arange(500), "label": np.zeros(500, int), "q": pa.array(values.tolist(), pa.list_(pa.int32())), "codes": [bytes(c) for c in codes], "left": left})
    anchors, rows = hard_negatives.Anchors(table.slice(0, 40), 7, books), hard_negatives.Rows(table, 7, len(books))
    low, high = anchors.bounds(np.arange(40), rows, np.arange(500))
    exact = values[:40] @ values.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < np.abs(exact).mean()
