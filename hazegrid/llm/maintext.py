"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element is a node with features of its subtree (text, words, links, blocks, punctuation), of its attribute
tokens and those above it, of its depth and of its siblings. Boosted trees give the probability that a node is
part of the article. Decoding is hierarchical: along every path from the root nodes lie *around* the article, then in it, then
in what is *cut* from it; of all such labellings the likeliest is taken, so nothing under a cut node and no text around
the article is kept, whatever single nodes say.

The trees are trained here on at most ``TRAIN_PAGES`` pages of the table (the smallest hashes of page ids among pages of at most ``TRAIN_CHARS``
characters that mark an article by its element), as they are and laid out anew ``LAYOUTS`` times each: other containers, other or
meaningless class names, adverts, notices, forms, sidebars and reader comments around and inside, with words from
the same pages. That bounded sample is all that reaches the driver; every page is read whole by the tasks.

Defined results: null or empty html gives an empty text and 0 characters; white space is Unicode's; repeated rows
give repeated rows; a table without marked pages trains on invented words.
"""

from __future__ import annotations

import html as html_text
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import texts
from hazegrid.llm.dom import DEAD, HEADINGS, Page

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS = 240, 100_000, 4
ROUNDS, DEPTH, BINS, RATE, RIDGE = 80, 5, 32, 0.2, 1.0
TOKEN_PRIOR = 4.0
BATCH_CHARS = 1 << 20
_STOPS = re.compile(r"[.!?;:,…]")


# --- features -----------------------------------------------------------------------------------


class Nodes:
    """All nodes of some pages, one page after the other, as arrays."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        sizes = np.array([len(p.tag) for p in pages], dtype=np.int64)
        self.start = np.cumsum(sizes) - sizes
        base = np.repeat(self.start, sizes)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.n = int(sizes.sum())
        self.parent = np.array([x for p in pages for x in p.parent], dtype=np.int64)
        self.parent = np.where(self.parent < 0, -1, self.parent + base)
        self.stop = np.array([x for p in pages for x in p.stop], dtype=np.int64) + base
        self.tag = [t for p in pages for t in p.tag]
        self.tokens = [(f"<{t}>", *w) for p in pages for t, w in zip(p.tag, p.words)]
        self.controls = np.array([x for p in pages for x in p.controls], dtype=np.float64)
        run_node = [x + s for p, s in zip(pages, self.start.tolist()) for x in p.run_node]
        run_text = [t for p in pages for t in p.run_text]
        self.run_node = np.array(run_node, dtype=np.int64)

        def own(values: list) -> np.ndarray:
            return np.bincount(self.run_node, np.array(values, dtype=np.float64), self.n) if run_node else np.zeros(self.n)

        self.chars = own(list(map(len, run_text)))
        self.links = own([x for p in pages for x in p.run_linked])
        self.words = own([t.count(" ") + 1 for t in run_text])
        self.stops = own([len(_STOPS.findall(t)) for t in run_text])
        self.runs = own([1] * len(run_text))
        depth = np.zeros(self.n, dtype=np.int64)
        self.levels = []  # nodes by depth; a parent stands before its children
        here = np.flatnonzero(self.parent < 0)
        order = np.argsort(self.parent, kind="stable")
        sorted_parent = self.parent[order]
        while len(here):
            self.levels.append(here)
            depth[here] = len(self.levels) - 1
            a, b = np.searchsorted(sorted_parent, here), np.searchsorted(sorted_parent, here, side="right")
            n = b - a
            here = order[np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        self.depth = depth
        # siblings in page order
        self.rank = np.zeros(self.n, dtype=np.int64)
        first = np.searchsorted(sorted_parent, sorted_parent)
        self.rank[order] = np.arange(self.n) - first
        self.prior, self.next = np.full(self.n, -1), np.full(self.n, -1)
        same = np.flatnonzero((sorted_parent[1:] == sorted_parent[:-1]) & (sorted_parent[1:] >= 0))
        self.prior[order[same + 1]] = order[same]
        self.next[order[same]] = order[same + 1]

    def under(self, own: np.ndarray) -> np.ndarray:
        """Sum over each subtree."""
        upto = np.r_[0.0, np.cumsum(own)]
        return upto[self.stop] - upto[np.arange(self.n)]

    def over(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most along the path from the root to each node."""
        low, high = own.copy(), own.copy()
        for here in self.levels[1:]:
            p = self.parent[here]
            low[here] = np.minimum(low[here], low[p])
            high[here] = np.maximum(high[here], high[p])
        return low, high

    def features(self, worth: dict[str, float]) -> np.ndarray:
        """``worth``: what each attribute token or tag says for (positive) or against the article."""
        token = np.array([max(-4.0, min(4.0, sum(worth.get(t, 0.0) for t in ts))) for ts in self.tokens])
        low, high = self.over(token)
        tag = np.array([1 if t == "p" else 2 if t in HEADINGS else 3 if t in ("li", "dd", "dt") else 4 if t in ("ul", "ol", "dl") else
                        5 if t in ("td", "th", "tr", "table", "tbody") else 6 if t == "div" else 0 for t in self.tag], dtype=np.float64)
        chars, links, words, stops, runs = map(self.under, (self.chars, self.links, self.words, self.stops, self.runs))
        count = self.stop - np.arange(self.n)
        root = self.start[self.page]
        up = np.maximum(self.parent, 0)
        siblings = np.bincount(up[self.parent >= 0], minlength=self.n)[up]
        twins = np.bincount(up[self.parent >= 0], (tag[up] != 0)[self.parent >= 0], self.n)
        before = np.r_[0.0, np.cumsum(self.chars)][np.arange(self.n)] - np.r_[0.0, np.cumsum(self.chars)][root]
        page_chars = np.maximum(chars[root], 1.0)
        page_runs = np.maximum(runs[root], 1.0)

        def at(i: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.where(i >= 0, values[np.maximum(i, 0)], -1.0)

        density, share = np.log1p(chars) - np.log1p(count), links / np.maximum(chars, 1.0)
        p_under, h_under, li_under = (self.under((tag == k).astype(float)) for k in (1, 2, 3))
        return np.stack([
            np.log1p(chars), np.log1p(self.chars), share, self.links / np.maximum(self.chars, 1.0), density, words / np.maximum(runs, 1.0), stops / np.maximum(words, 1.0),
            self.depth, chars / page_chars, chars / np.maximum(chars[up], 1.0), runs / page_runs, self.rank, self.rank / np.maximum(siblings, 1), np.log1p(siblings), np.log1p(twins),
            at(self.prior, density), at(self.next, density), at(self.prior, share), at(self.next, share), at(self.prior, np.log1p(chars)), at(self.next, np.log1p(chars)),
            at(self.prior, token), at(self.next, token), np.log1p(p_under), np.log1p(h_under), li_under / count, np.log1p(self.under(self.controls)), token, low, high,
            self.under(token) / count, before / page_chars, (before + chars) / page_chars, tag, at(self.parent, tag), at(self.parent, density), at(self.parent, share),
        ], axis=1)


# --- boosted trees --------------------------------------------------------------------------------


class Boosted:
    """Logistic boosting of complete trees on binned features; ``chance`` is what it believes of each row."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE):
        self.rounds, self.depth, self.bins, self.rate, self.ridge = rounds, depth, bins, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.arange(1, self.bins) / self.bins)) for c in x.T]
        bin_ = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)])  # of value <= cut
        mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score, inner = np.full(len(y), self.start), (1 << self.depth) - 1
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            slope, bend = y - p, p * (1 - p)
            feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                local = node - first
                best, choice, cut = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, dtype=np.int64)
                for f, b in enumerate(bin_):
                    if not len(cuts[f]):
                        continue
                    at = local * self.bins + b
                    g = np.cumsum(np.bincount(at, slope, width * self.bins).reshape(width, -1), axis=1)
                    h = np.cumsum(np.bincount(at, bend, width * self.bins).reshape(width, -1), axis=1)
                    gain = g ** 2 / (h + self.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    gain = gain[:, :len(cuts[f])]
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best[better], choice[better], cut[better] = gain[np.arange(width), k][better], f, k[better]
                for i in np.flatnonzero(choice >= 0):
                    feature[first + i], limit[first + i] = choice[i], cuts[choice[i]][cut[i]]
                right = (choice[local] >= 0) & (bin_[np.maximum(choice, 0)[local], np.arange(len(y))] > cut[local])
                node = 2 * node + 1 + right
            leaf = node - inner
            value = self.rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + self.ridge)
            score += value[leaf]
            self.trees.append((feature, limit, value))
        return self

    def chance(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))


# --- decoding --------------------------------------------------------------------------------------


def decode(nodes: Nodes, chance: np.ndarray) -> np.ndarray:
    """Whether each node is in the article: the likeliest labelling around* main* cut* along every path."""
    weight = 0.3 + np.log1p(nodes.chars)
    chance = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = weight * np.log(chance), weight * np.log(1 - chance)
    cut, main, around = nodes.under(no), yes.copy(), no.copy()
    for here in reversed(nodes.levels[1:]):
        np.add.at(main, nodes.parent[here], np.maximum(main[here], cut[here]))
        np.add.at(around, nodes.parent[here], np.maximum(around[here], main[here]))
    state = np.zeros(nodes.n, dtype=np.int64)  # 0 around, 1 main, 2 cut
    roots = nodes.levels[0]
    state[roots] = main[roots] > around[roots]
    for here in nodes.levels[1:]:
        above = state[nodes.parent[here]]
        state[here] = np.where(above == 0, main[here] > around[here], np.where((above == 1) & (main[here] >= cut[here]), 1, 2))
    return state == 1


class Extractor:
    """Token values and trees, ready for pages."""

    def __init__(self, worth: dict[str, float], trees: Boosted):
        self.worth, self.trees = worth, trees

    def __call__(self, pages: list[Page]) -> list[str]:
        nodes = Nodes(pages)
        keep = decode(nodes, self.trees.chance(nodes.features(self.worth)))
        out = []
        for p, start in zip(pages, nodes.start.tolist()):
            out.append("\n\n".join(t for n, t in zip(p.run_node, p.run_text) if keep[start + n]))
        return out


# --- training ----------------------------------------------------------------------------------------

# usual names of what surrounds an article, and of what holds it; parts of pages for training
_OUTSIDE = {
    "header": "header masthead banner top site-header topbar branding", "menu": "nav menu navbar main-nav navigation breadcrumb tabs toolbar",
    "notice": "cookie consent gdpr notice alert message popup modal subscribe-bar announcement", "advert": "ad ads advert sponsored promo banner-ad adsense outbrain sponsor",
    "side": "sidebar aside widget related recent popular tags archive trending more-stories", "form": "newsletter signup search login contact-form subscribe",
    "share": "share social sharing follow buttons", "comments": "comments comment-list disqus responses replies discussion reader-comments", "footer": "footer bottom copyright colophon legal site-info",
}
_INSIDE = "article post entry content story main text body post-content article-body entry-content story-text main-content single page-content"
_BLANK = "box block col row wrap inner outer section container group x1 b2 unit area part"
_SEMANTIC = {"header": ("header", "div"), "menu": ("nav", "div", "ul", "section"), "notice": ("div", "section", "aside"), "advert": ("div", "aside", "section"), "side": ("aside", "div", "section"),
             "form": ("form", "div"), "share": ("div", "ul"), "comments": ("section", "div", "aside"), "footer": ("footer", "div")}
_INVENTED = "the of and river house stone to in light water was green for old with new garden that winter from market letter it window by harbour".split()


def marked(page: Page) -> np.ndarray | None:
    """1 for nodes of the article elements, without what is plainly not part of it; None if the page marks none."""
    if "article" in page.tag:
        wanted = "article"
    elif "main" in page.tag:
        wanted = "main"
    else:
        return None
    out = np.zeros(len(page.tag), dtype=np.int64)
    for i, (t, p) in enumerate(zip(page.tag, page.parent)):
        inside = out[p] == 1 if p >= 0 else False
        out[i] = (inside or t == wanted) and t not in ("nav", "aside", "footer", "form") and t not in DEAD
    return out


class Layouts:
    """Pages with known articles, in invented layouts, from given paragraphs."""

    def __init__(self, sources: list[list[str]], seed: int):
        self.sources, self.r = sources, random.Random(seed)

    def _words(self, n: int) -> str:
        words = self.r.choice(self.r.choice(self.sources)).split()
        i = self.r.randrange(max(1, len(words) - n + 1))
        return " ".join(words[i:i + n])

    def _name(self, names: str, plain: float = 0.3) -> str:
        pick = self.r.random()
        name = self.r.choice(_BLANK.split()) if pick < plain else self.r.choice(names.split())
        return self.r.choice(('class="{}"', 'id="{}"', 'class="{} c{}"')).format(name, self.r.randrange(9)) if pick < 0.92 else ""

    def _links(self, n: int) -> str:
        items = [f'<a href="/x">{html_text.escape(self._words(self.r.randint(1, 4)))}</a>' for _ in range(n)]
        return "<ul><li>" + "<li>".join(items) + "</ul>" if self.r.random() < 0.6 else self.r.choice((" | ", " ", "<br>")).join(items)

    def _sentences(self, least: int, most: int) -> str:
        return html_text.escape(self._words(self.r.randint(least, most)))

    def outside(self, kind: str) -> str:
        r = self.r
        inner = {
            "header": lambda: f"<h2>{self._sentences(1, 4)}</h2>" + (self._links(r.randint(2, 6)) if r.random() < 0.6 else f"<p>{self._sentences(2, 9)}</p>"),
            "menu": lambda: self._links(r.randint(3, 12)), "notice": lambda: f"<p>{self._sentences(5, 40)}</p><button>OK</button>" if r.random() < 0.6 else self._sentences(4, 30),
            "advert": lambda: self._sentences(2, 30) if r.random() < 0.6 else f'<a href="/ad">{self._sentences(3, 12)}</a><p>{self._sentences(3, 25)}</p>',
            "side": lambda: f"<h3>{self._sentences(1, 4)}</h3>" + (self._links(r.randint(3, 9)) if r.random() < 0.6 else "".join(f"<p>{self._sentences(5, 40)}</p>" for _ in range(r.randint(1, 3)))),
            "form": lambda: f"<p>{self._sentences(2, 15)}</p><label>{self._sentences(1, 2)}</label><input name=q><button>Go</button>", "share": lambda: self._links(r.randint(2, 5)),
            "comments": lambda: f"<h3>{self._sentences(1, 3)}</h3>" + "".join(f"<div {self._name('comment reply comment-body', 0.4)}><b>{self._sentences(1, 2)}</b><p>{self._sentences(4, 70)}</p></div>" for _ in range(r.randint(1, 6))),
            "footer": lambda: f"&copy; {self._sentences(1, 6)} " + (self._links(r.randint(2, 6)) if r.random() < 0.4 else f"<p>{self._sentences(3, 20)}</p>"),
        }[kind]()
        tag = r.choice(_SEMANTIC[kind])
        return f'<{tag} {self._name(_OUTSIDE[kind])} data-label="0">{inner}</{tag}>'

    def page(self, paragraphs: list[str]) -> str:
        r = self.r
        parts = []
        style = r.choice(("p", "p", "p", "div", "br"))
        for i, text in enumerate(paragraphs):
            text = html_text.escape(text)
            if i == 0 and r.random() < 0.8:
                parts.append(f"<h1>{text}</h1>")
                continue
            kind = r.random()
            if kind < 0.08:
                parts.append(f"<ul><li>{text}<li>{self._sentences(2, 12)}</ul>")
            elif kind < 0.14:
                parts.append(f"<h2>{self._sentences(1, 6)}</h2><p>{text}</p>")
            elif kind < 0.18:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.22:
                parts.append(f"<p>{text} <a href='/y'>{self._sentences(1, 5)}</a></p>")
            else:
                parts.append(f"<p>{text}</p>" if style == "p" else f"<div>{text}</div>" if style == "div" else f"<p><b>{text}<br>")
            if r.random() < 0.1:
                parts.append(self.outside(r.choice(("advert", "advert", "form", "share", "side", "notice"))))
        if r.random() < 0.2:
            parts.append(self.outside(r.choice(("comments", "comments", "share", "form", "side"))))
        tag = r.choice(("article", "main", "div", "div", "section", "td"))
        start = f'<{tag} {self._name(_INSIDE)} data-label="1">'
        body = start + "".join(parts) + f"</{tag}>"
        if tag == "td":
            left = f'<td data-label="0">{self._links(r.randint(2, 8))}</td>' if r.random() < 0.6 else ""
            body = f'<table data-label="0"><tr>{left}{body}</tr></table>'
        before = [self.outside(k) for k in ("header", "menu", "notice", "advert", "side", "form") if r.random() < 0.45]
        behind = [self.outside(k) for k in ("share", "comments", "side", "notice", "form", "advert", "footer") if r.random() < 0.45]
        if r.random() < 0.5:
            body = f'<div {self._name("page wrapper container site layout")} data-label="0">{body}{"".join(behind[:-1])}</div>'
            behind = behind[-1:]
        return f'<html><head><title>{html_text.escape(paragraphs[0][:60])}</title></head><body data-label="0">{"".join(before)}{body}{"".join(behind)}</body></html>'


def train(sources: list[str], seed: int = 42) -> Extractor:
    """Fit token values and trees on the given pages and on new layouts of their articles."""
    pages, labels, articles = [], [], []
    for source in sources:
        page = Page(source)
        label = marked(page)
        texts_ = [] if label is None else [t for n, t in zip(page.run_node, page.run_text) if label[n]]
        if texts_:
            pages.append(page), labels.append(label), articles.append(texts_)
    if len(articles) < 20:
        r = random.Random(seed)
        articles += [[" ".join(r.choices(_INVENTED, k=r.randint(2, 60))).capitalize() + "." for _ in range(r.randint(2, 12))] for _ in range(60)]
    layouts = Layouts(articles, seed)
    for _ in range(LAYOUTS):
        for texts_ in articles:
            page = Page(layouts.page(texts_[:1] + texts_[1:][:layouts.r.choice((1, 3, 10, 1000))]))
            pages.append(page), labels.append(np.array([m == "1" for m in page.mark], dtype=np.int64))
    nodes, y = Nodes(pages), np.concatenate(labels).astype(np.float64)
    yes: dict[str, float] = {}
    no: dict[str, float] = {}
    for tokens, label in zip(nodes.tokens, y.tolist()):
        for t in tokens:
            side = yes if label else no
            side[t] = side.get(t, 0.0) + 1
    ratio = (len(y) - y.sum() + 1) / (y.sum() + 1)
    worth = {t: float(np.log((yes.get(t, 0) * ratio + TOKEN_PRIOR) / (no.get(t, 0) + TOKEN_PRIOR))) for t in sorted({*yes, *no}) if yes.get(t, 0) + no.get(t, 0) >= 3}
    return Extractor(worth, Boosted().fit(nodes.features(worth), y))


# --- Spark -------------------------------------------------------------------------------------------


def training_pages(pages: DataFrame, page_id: str, html: str) -> list[str]:
    """At most ``TRAIN_PAGES`` pages that mark an article: a fixed, bounded sample by the hash of the id."""
    source = F.col(f"`{html}`")
    fits = (F.length(source) <= TRAIN_CHARS) & F.lower(source).rlike("<(article|main)[ >]")
    name = F.xxhash64(F.col(f"`{page_id}`").cast("string"))
    # first only the names, so that tasks send no pages that are not taken
    chosen = [r.h for r in pages.where(fits).select(name.alias("h")).orderBy("h").limit(TRAIN_PAGES).collect()]
    rows = pages.where(name.isin(chosen) & fits).select(name.alias("h"), F.md5(source.cast("binary")).alias("m"), source.alias("s"))
    return [r.s for r in rows.dropDuplicates(["h", "m"]).orderBy("h", "m").limit(TRAIN_PAGES).collect()] if chosen else []


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", extractor: Extractor | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(extractor or train(training_pages(pages, page_id, html)))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = texts(b.column("html"))
            i = 0
            while i < len(sources):
                j, held = i, 0
                while j < len(sources) and (j == i or held + len(sources[j]) <= BATCH_CHARS):
                    held += len(sources[j])
                    j += 1
                found = model.value([Page(s.decode()) for s in sources[i:j]])
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(i, j - i), b.column("url").slice(i, j - i), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])
                i = j

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(extract, f"{kinds}, text string, n_chars long")
