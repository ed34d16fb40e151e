"""Op 11: main text of web pages by boosted trees over the nodes of the page's block tree.

Nodes are elements that make blocks, and runs of text (html_tree). Each has features of its subtree (text, links,
words, punctuation, density, forms), its place (depth, position, siblings and their text, parents) and its tags and
attribute words, given as the log-odds that training found for them, its own and its ancestors'. Trees give
each node the log-odds that its subtree holds main text.

Decoding is over the whole tree: a node is in only if its parent is, so no descendant contradicts an ancestor, and
the set of nodes with the greatest sum of log-odds is taken, exactly, from the leaves up. The text is the runs
that are in, in page order.

There are no labels in `pages`, so training makes them: SAMPLE_PAGES pages of the table (least hash, at most
SAMPLE_BYTES each, so the model is fitted on bounded rows) are taken as they are, with what their own landmarks say
(article or main, outside nav, header, footer, aside, form and blocks named as adverts or comments), and
their runs of text are set anew, with a fixed seed, into LAYOUTS page layouts of known main text: menus, sidebars,
notices, adverts, forms, reader comments, with and without landmarks and telling names.

Defined results: null or empty html, and pages on which nothing is worth keeping, give an empty text; repeated
rows each give one; an empty table gives an empty result; pages of any length are read whole. References are decoded,
white space (also no-break spaces) inside a block becomes one space, and a line break inside a block is white
space. Text in controls (buttons, choices), titles and other parts that are not shown is never main text; other
columns are not read.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import least_by_hash, read_table
from .html_tree import HEADINGS, TEXT, Page, parse

SAMPLE_PAGES, SAMPLE_BYTES, LAYOUTS, SEED = 300, 32 << 10, 700, 11
#: Nodes that are scored at a time.
CHUNK_NODES = 20_000
GROUPS = [frozenset(g.split()) for g in (TEXT, "p", "li", "ul ol dl menu", "h1", "h2 h3 h4 h5 h6", "div section", "article main", "nav header footer aside form fieldset dialog address", "table thead tbody tr td th", "blockquote pre figure figcaption details")]
LANDMARK_IN, LANDMARK_OUT = frozenset(["article", "main"]), frozenset("nav header footer aside form dialog".split())
# Words that pages name their parts with.
NAMES = {
    "main": "article content post entry story main body text page prose markdown single detail blog news articlebody",
    "menu": "nav navbar navigation menu topbar breadcrumb breadcrumbs pagination pager toc tabs links",
    "header": "header masthead banner top branding logo title hero",
    "footer": "footer foot bottom copyright legal colophon credits",
    "side": "sidebar aside widget related recommended popular trending rail secondary recent archive categories tags",
    "notice": "notice cookie cookies consent gdpr alert message popup modal overlay warning announcement paywall",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp taboola outbrain",
    "form": "form newsletter subscribe signup search login contact register feedback",
    "comments": "comments comment reply replies respond discussion disqus thread responses commentlist",
    "share": "share social sharing follow buttons toolbar actions tools",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
NEUTRAL = "container wrapper wrap row col inner outer grid box block section layout site page-wrap css module group panel item holder".split()
BAD_NAMES = frozenset(w for k in ("advert", "comments", "notice", "share") for w in NAMES[k])


class Forest:
    """The nodes of several pages in one run of arrays; level by level, sums go up and values go down."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages])
        self.ends = np.cumsum(sizes)
        self.root = np.repeat(self.ends - sizes, sizes)
        parent = np.array([q for p in pages for q in p.parent])
        self.is_root = parent < 0
        self.parent = np.where(self.is_root, np.arange(len(parent)), parent + self.root)
        self.depth = np.array([d for p in pages for d in p.depth])
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, self.depth.max() + 1)))[1:]
        self.tag = [t for p in pages for t in p.tag]
        self.tokens = [t for p in pages for t in p.tokens]
        self.text = [t for p in pages for t in p.text]
        self.linked = np.array([v for p in pages for v in p.linked], dtype=float)
        self.controls = np.array([v for p in pages for v in p.controls], dtype=float)

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.copy()
        for level in reversed(self.levels):
            np.add.at(out, self.parent[level], out[level])
        return out

    def along(self, values: np.ndarray, choose) -> np.ndarray:
        """choose (np.maximum, np.minimum) of a node's own value and its ancestors'."""
        out = values.copy()
        for level in self.levels:
            out[level] = choose(out[level], out[self.parent[level]])
        return out


def _by_name(names: list, value) -> np.ndarray:
    """value(name) of each, once for each distinct name."""
    distinct = {name: None for name in names}
    found = {name: value(name) for name in distinct}
    return np.array([found[name] for name in names], dtype=float)


def _own(text: str) -> tuple:
    if not text:
        return (0, 0, 0, 0, 0)
    return (len(text), text.count(" ") + 1, 1, sum(map(text.count, ".,;:!?。，")), sum(map(str.isdigit, text)) if len(text) < 200 else 0)


def features(forest: Forest, odds: dict[str, float]) -> np.ndarray:
    """A row for each node."""
    n, up, start = len(forest.tag), forest.parent, forest.root
    own = np.array([_own(t) for t in forest.text], dtype=float)
    controls = forest.controls + _by_name(forest.tag, lambda t: t == "form")
    kinds_of = _by_name(forest.tag, lambda t: (t in HEADINGS, t == "h1", t == "p", t == "li"))
    sums = forest.below(np.column_stack([own, forest.linked, controls, np.ones(n), kinds_of]))
    chars, words, runs, marks, digits, linked, controls, tags = sums[:, :8].T
    heads = sums[:, 8:]
    total = np.maximum(1.0, chars[start])
    begins = np.cumsum(own[:, 0]) - own[:, 0]
    begins -= begins[start]
    density, links, per_run = chars / tags, linked / np.maximum(chars, 1), chars / np.maximum(runs, 1)
    # siblings, in page order
    group = np.where(forest.is_root, -1 - np.arange(n), up)
    order = np.lexsort((np.arange(n), group))
    same = group[order][1:] == group[order][:-1]
    before, after = np.full(n, -1), np.full(n, -1)
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    kids = np.bincount(up[~forest.is_root], minlength=n)
    nth = np.zeros(n)
    nth[order] = np.arange(n) - np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(n), 0))
    kinds: dict[tuple, int] = {}
    kind = [kinds.setdefault(k, len(kinds)) for k in zip(group.tolist(), forest.tag, forest.tokens, strict=True)]
    alike = np.bincount(kind)[kind]
    # words of names and tags
    names = _by_name(forest.tokens, lambda ts: (max([0.0, *(odds[t] for t in ts if t in odds)]), min([0.0, *(odds[t] for t in ts if t in odds)])))
    high, low = names.T
    tag_odds = _by_name(forest.tag, lambda t: odds.get(f"<{t}>", 0.0))
    down = forest.along(np.column_stack([high, -low, np.maximum(tag_odds, 0), np.maximum(-tag_odds, 0), _by_name(forest.tag, lambda t: (t in LANDMARK_IN, t in LANDMARK_OUT))]), np.maximum)
    near = lambda values, at, none: np.where(at >= 0, values[at], none)
    log = np.log1p
    columns = [
        log(chars), log(words), links, log(runs), log(tags), log(density), marks / np.maximum(words, 1), log(per_run), digits / np.maximum(chars, 1), log(controls),
        forest.depth, chars / total, begins / total, (begins + chars) / total, chars / np.maximum(chars[up], 1), nth, kids[up], kids, log(alike), alike / np.maximum(kids[up], 1),
        near(log(chars), before, -1), near(log(chars), after, -1), near(links, before, -1), near(links, after, -1), near(log(per_run), before, -1), near(log(per_run), after, -1), near(tag_odds, before, -9), near(tag_odds, after, -9), near(low, before, 9), near(low, after, 9),
        links[up], log(per_run[up]), log(density[up]), log(controls[up]), tag_odds[up], tag_odds, high, low, down, heads[:, :2], heads[:, 2:] / tags[:, None], heads[:, 1][up],
    ]
    groups = _by_name(forest.tag, lambda t: tuple(t in g for g in GROUPS))
    return np.column_stack([*columns, groups, groups[up]]).astype(np.float32)


def decode(forest: Forest, score: np.ndarray) -> list[str]:
    """For each page the runs of text in the set of nodes, closed under parents, with the greatest sum of scores."""
    total = score.copy()
    for level in reversed(forest.levels):
        gain = level[total[level] > 0]
        np.add.at(total, forest.parent[gain], total[gain])
    inside = total > 0
    for level in forest.levels:
        inside[level] &= inside[forest.parent[level]]
    begin, out = 0, []
    for end in forest.ends:
        out.append("\n".join(forest.text[i] for i in begin + np.flatnonzero(inside[begin:end]) if forest.text[i]))
        begin = end
    return out


# training


def _named(rng: random.Random, kind: str, tag: str, telling: float, classes: float = 0.85) -> tuple[str, str]:
    """A start and an end tag, with a telling name, a neutral one or none."""
    if rng.random() < telling:
        names = rng.sample(NAMES[kind], rng.choice((1, 1, 2)))
        name = rng.choice(("-", "_", " ")).join(names + ([rng.choice(NEUTRAL)] if rng.random() < 0.4 else []))
        attribute = f' {rng.choice(("class", "class", "id"))}="{name}"'
    elif rng.random() < classes:
        attribute = f' class="{rng.choice(NEUTRAL)}{rng.choice(("", "", rng.randint(1, 99)))}"'
    else:
        attribute = ""
    return f"<{tag}{attribute}>", f"</{tag}>"


class Layout:
    """One page of known main text, set from runs of text."""

    def __init__(self, rng: random.Random, texts: list[str]):
        self.rng, self.texts = rng, texts
        self.telling = rng.choice((0.0, 0.5, 0.9, 1.0))
        self.landmarks = rng.choice((0.0, 0.5, 1.0))

    def words(self, least: int, most: int) -> str:
        w, n = self.rng.choice(self.texts).split(), self.rng.randint(least, most)
        while len(w) < n:
            w += self.rng.choice(self.texts).split()
        at = self.rng.randint(0, len(w) - n)
        return escape(" ".join(w[at : at + n]), quote=False)

    def long(self) -> str:
        return escape(self.rng.choice(self.texts), quote=False) if self.rng.random() < 0.6 else self.words(3, 60)

    def around(self, kind: str, tag: str, inner: str) -> str:
        start, end = _named(self.rng, kind, tag if self.rng.random() < self.landmarks else self.rng.choice(("div", "div", "section")), self.telling)
        return start + inner + end

    def links(self, kind: str, least: int = 3, most: int = 12, tag: str = "nav") -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.rng.randint(least, most))]
        return self.around(kind, tag, f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if self.rng.random() < 0.7 else self.rng.choice((" | ", " ", "")).join(items))

    def header(self) -> str:
        return self.around("header", "header", (f"<h1>{self.words(1, 4)}</h1>" if self.rng.random() < 0.3 else f"<div>{self.words(1, 4)}</div>") + (f"<p>{self.words(2, 10)}</p>" if self.rng.random() < 0.5 else "") + (self.links("menu") if self.rng.random() < 0.5 else ""))

    def footer(self) -> str:
        text = f"&copy; {self.words(1, 12)}" if self.rng.random() < 0.7 else f"<p>{self.words(4, 30)}</p>"
        return self.around("footer", "footer", text + (self.links("footer", 2, 6, "div") if self.rng.random() < 0.4 else ""))

    def side(self) -> str:
        parts = [self.rng.choice((lambda: self.links("side", 3, 8, "div"), lambda: f"<p>{self.words(5, 40)}</p>", self.advert, self.form))() for _ in range(self.rng.randint(1, 3))]
        return self.around("side", "aside", (f"<h3>{self.words(1, 4)}</h3>" if self.rng.random() < 0.7 else "") + "".join(parts))

    def notice(self) -> str:
        text = self.words(5, 40)
        return self.around("notice", "dialog", (f"<p>{text}</p>" if self.rng.random() < 0.6 else text) + ("<button>OK</button>" if self.rng.random() < 0.5 else ""))

    def advert(self) -> str:
        text = self.words(3, 25)
        text = self.rng.choice((text, f"<p>{text}</p>", f'<a href="//x.example/{self.rng.randint(1, 99)}">{text}</a>'))
        return _named(self.rng, "advert", self.rng.choice(("div", "div", "aside", "section", "ins")), max(self.telling, 0.8))[0].replace("<ins", "<div") + text + "</div>" if self.rng.random() < 0.7 else self.around("advert", "aside", text)

    def form(self) -> str:
        return self.around("form", "div", f"<form>{self.rng.choice(('', f'<p>{self.words(3, 15)}</p>'))}<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button></form>")

    def share(self) -> str:
        return self.links("share", 2, 6, "div")

    def comments(self) -> str:
        one = lambda: self.around("comments", "article", f"<{(t := self.rng.choice(('div', 'p', 'h4')))}>{self.words(1, 3)}</{t}><p>{self.long()}</p>" if self.rng.random() < 0.7 else f"<p>{self.words(4, 60)}</p>")
        listed = "".join(one() for _ in range(self.rng.randint(1, 6)))
        start, end = _named(self.rng, "comments", "section" if self.rng.random() < self.landmarks else "div", max(self.telling, 0.9))
        return start + (f"<h{(k := self.rng.randint(2, 4))}>{self.words(1, 3)}</h{k}>" if self.rng.random() < 0.7 else "") + listed + (self.form() if self.rng.random() < 0.4 else "") + end

    def block(self, plain: bool) -> str:
        r = self.rng.random()
        if r < 0.72 or plain:
            tag, text = ("p" if self.rng.random() < 0.9 else "div"), self.long()
            if self.rng.random() < 0.15:
                text = f"<b>{text}<br>"
            elif self.rng.random() < 0.2:
                text = f'{text} <a href="/{self.rng.randint(1, 99)}">{self.words(1, 5)}</a> {self.words(1, 20)}'
            return f"<{tag} data-main>{text}" + (f"</{tag}>" if tag == "div" or self.rng.random() < 0.85 else "")
        if r < 0.8:
            return f"<h{(k := self.rng.randint(2, 4))} data-main>{self.words(1, 8)}</h{k}>"
        if r < 0.87:
            items = "".join(f"<li data-main>{self.words(1, 25)}</li>" for _ in range(self.rng.randint(2, 6)))
            return self.rng.choice((f"<ul>{items}</ul>", f"<ol>{items}</ol>"))
        if r < 0.92:
            return f"<blockquote><p data-main>{self.words(5, 50)}</p></blockquote>"
        if r < 0.95:
            return f"<figure><img src=x><figcaption data-main>{self.words(2, 15)}</figcaption></figure>"
        if r < 0.98:
            rows = "".join(f"<tr>{''.join(f'<td data-main>{self.words(1, 5)}</td>' for _ in range(2))}</tr>" for _ in range(self.rng.randint(2, 5)))
            return f"<table>{rows}</table>"
        return f"<pre data-main>{self.words(5, 40)}</pre>"

    def article(self) -> str:
        rng = self.rng
        head = f"<h1 data-main>{self.words(1, 12)}</h1>" if rng.random() < 0.85 else ""
        if head and rng.random() < 0.15:
            head = f"<header>{head}</header>"
        body = [self.block(rng.random() < 0.5) for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14)))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            body.insert(rng.randint(0, len(body)), "</p>" + rng.choice((self.advert, self.share, self.side, self.notice))())
        if rng.random() < 0.25:
            body.append(rng.choice((self.share, self.comments, self.form))())
        inner = "".join(body)
        if rng.random() < 0.3:
            start, end = _named(rng, "main", "div", self.telling)
            inner = start + inner + end
        return self.around("main", rng.choice(("article", "article", "main")), head + inner)

    def page(self) -> str:
        rng = self.rng
        often = lambda p, part: [part()] if rng.random() < p else []
        middle = [*often(0.3, self.side), *often(0.2, self.advert), self.article(), *often(0.35, self.comments), *often(0.4, self.side), *often(0.2, lambda: self.links("side", 3, 8, "div"))]
        inner = "".join(middle)
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            inner = f"<div>{inner}</div>" if rng.random() < 0.3 else f'<div class="{rng.choice(NEUTRAL)}">{inner}</div>'
        parts = [*often(0.25, self.notice), *often(0.5, self.header), *often(0.75, lambda: self.links("menu")), *often(0.4, self.advert), inner, *often(0.2, self.form), *often(0.8, self.footer), *often(0.15, self.notice)]
        return f"<html><body>{''.join(parts)}" + ("</body></html>" if rng.random() < 0.8 else "")


def _labels(page: Page, held: list[bool]) -> np.ndarray:
    """A node is main if its subtree holds main text."""
    return np.minimum(Forest([page]).below(np.array(held, dtype=float)), 1.0)


def _by_landmarks(page: Page) -> np.ndarray | None:
    """Labels that a page's own landmarks give; none without them."""
    if not LANDMARK_IN & set(page.tag):
        return None
    state: list[tuple[bool, bool]] = []
    for tag, words, p in zip(page.tag, page.tokens, page.parent, strict=True):
        inside, out = state[p] if p >= 0 else (False, False)
        state.append((inside or tag in LANDMARK_IN, out or tag in LANDMARK_OUT or bool(BAD_NAMES & set(words))))
    return _labels(page, [bool(t) and a and not b for t, (a, b) in zip(page.text, state, strict=True)])


def _by_marks(page: Page) -> np.ndarray:
    return _labels(page, [bool(t) and page.main[p] for t, p in zip(page.text, page.parent, strict=True)])


@dataclass
class Extractor:
    trees: boosting.Boosted
    odds: dict[str, float]

    def texts(self, pages: list[Page]) -> list[str]:
        forest = Forest(pages)
        return decode(forest, self.trees.scores(features(forest, self.odds)))


def train(sample: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Extractor:
    """sample: html of some pages; without any text in them, words of a few letters stand in."""
    real = [parse(h) for h in sample]
    texts = [t for p in real for t in p.text if t] or ["one two three four five six seven.", "eight, nine and ten."]
    rng = random.Random(seed)
    made = [parse(Layout(rng, texts).page()) for _ in range(layouts)]
    known = [(p, y) for p, y in [(p, _by_landmarks(p)) for p in real] + [(p, _by_marks(p)) for p in made] if y is not None]
    counts: dict[str, list[float]] = {}
    for page, y in known:
        for tag, words, v in zip(page.tag, page.tokens, y, strict=True):
            for t in (*words, f"<{tag}>"):
                c = counts.setdefault(t, [0.0, 0.0])
                c[int(v)] += 1
    odds = {t: float(np.log((b + 1) / (a + 1))) for t, (a, b) in counts.items() if a + b >= 5}
    x = features(Forest([p for p, _ in known]), odds)
    y = np.concatenate([y for _, y in known])
    # each page counts alike, however many nodes it has
    weight = np.concatenate([np.full(len(y), (len(y) + 20) ** -0.5) for _, y in known])
    return Extractor(boosting.fit(x, y, weight / weight.mean()), odds)


def fit(pages: DataFrame) -> Extractor:
    picked = least_by_hash(pages.select("html").filter(F.octet_length("html") <= SAMPLE_BYTES), SAMPLE_PAGES, "html")
    return train([r.html for r in picked.collect()])  # SAMPLE_PAGES rows


def extract(pages: DataFrame, model: Extractor) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}

    def run(batches):
        own = held.value
        for batch in batches:
            source, names = batch.column("html"), ("page_id", "url")
            at = 0
            while at < batch.num_rows:
                first, trees, nodes = at, [], 0
                while at < batch.num_rows and nodes < CHUNK_NODES:
                    trees.append(parse(source[at].as_py() or ""))
                    nodes += len(trees[-1].tag)
                    at += 1
                texts = own.texts(trees)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, at - first) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op11_main_text(spark, sf_dir) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
