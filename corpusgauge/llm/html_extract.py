"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is cut into elements and text nodes.  Each node has features: its tag, its depth,
attribute tokens, the density of text, links and tags in its subtree, its place among
its siblings and in the page.  Boosted trees give the odds that a node holds main text;
hierarchical decoding then picks the most likely set of nodes in which a node is kept
only together with all its ancestors, so that no choice contradicts another.

The trees are trained here, on a bounded sample of the pages given.  Their labels come
from structure that pages declare themselves (``article`` or ``main`` against ``nav``,
``footer``, ``aside``, ``form`` ... and telling class names); into copies of the sample
pages boilerplate of known kinds is planted, and the declaring tags are taken away, so
that the trees learn more than tag names.

Text is taken from the kept nodes: character references decoded, white space within a
block made one space, blocks joined in page order by one space.  A null or empty html
gives an empty text, an unfinished tag or comment at a page's end is markup, broken
nesting is read leniently.  Equal rows give equal results; other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.frames import map_batches

#: Pages the trees are trained on at most, those with the smallest id hashes.
TRAINING_PAGES = 240
#: Characters of a training page at most; longer pages are passed over in training.
TRAINING_CHARS = 60_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 40, 4, 48, 0.25, 8

# --- nodes --------------------------------------------------------------------------

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr img".split()
)
#: Tags that a new one of the same group ends.
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table select article section div body html nav footer aside form".split())

_DECLARED_REST = frozenset("nav footer header aside form menu dialog button select head title figure".split())
_DECLARED_MAIN = frozenset(("article", "main"))
_REST_TOKENS = frozenset(
    "ad ads advert advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent"
    " cookie cookies copyright dialog disclaimer discussion footer form gdpr header hero login masthead menu modal"
    " nav navbar navigation newsletter notice notification pager pagination pagenav popup privacy promo promoted"
    " recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe tags toolbar topbar widget".split()
)
_MAIN_TOKENS = frozenset("article body content entry main post story text".split())
_GROUPS = {
    **dict.fromkeys("p blockquote pre".split(), 1),
    **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 2),
    **dict.fromkeys("ul ol dl li dt dd menu".split(), 3),
    **dict.fromkeys("div section body html".split(), 4),
    **dict.fromkeys("article main".split(), 5),
    **dict.fromkeys("nav header footer aside dialog".split(), 6),
    **dict.fromkeys("form input button select option label fieldset".split(), 7),
    **dict.fromkeys("table tbody thead tfoot tr td th caption".split(), 8),
    **dict.fromkeys("head title meta link".split(), 9),
    "a": 10,
}


@dataclass
class Page:
    """Nodes in page order; a parent comes before its children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    """Empty for text nodes."""
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    """Number of block borders before a text node."""

    def add(self, parent: int, tag: str, tokens: tuple[str, ...], text: str, block: int) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.tokens, tokens), (self.text, text), (self.block, block)):
            column.append(value)
        return len(self.parent) - 1


def tokens_of(rest: str) -> tuple[str, ...]:
    found = []
    for groups in _ATTRIBUTE.findall(rest):
        found += [t.lower() for t in _TOKEN.findall("".join(groups))]
    return tuple(found)


def read_page(source: str) -> Page:
    page = Page()
    open_ = [page.add(-1, "html", (), "", 0)]
    blocks, at = 0, 0

    # places in open_ of the open nodes of each tag, and of those that end a search
    places: dict[str, list[int]] = {}
    scopes: list[int] = []

    def close(names: Sequence[str], scoped: bool) -> None:
        last = max((places[name][-1] for name in names if places.get(name)), default=0)
        if not last or (scoped and scopes and scopes[-1] > last):
            return
        while len(open_) > last:
            tag = page.tag[open_.pop()]
            places[tag].pop()
            if tag in _SCOPE:
                scopes.pop()

    for m in _MARKUP.finditer(source):
        if m.start() > at:
            page.add(open_[-1], "", (), source[at : m.start()], blocks)
        at = m.end()
        name = m.group("name")
        if name is None:
            blocks += bool(m.group("raw"))
            continue
        name = name.lower()
        blocks += name not in _INLINE
        if m.group("end"):
            if name != "html":
                close((name,), False)
            continue
        if name == "html":
            page.tokens[0] = tokens_of(m.group("rest"))
            continue
        if name in _ENDS_P:
            close(("p",), True)
        if name in _ENDS_SAME:
            close(_ENDS_SAME[name], True)
        rest = m.group("rest")
        node = page.add(open_[-1], name, tokens_of(rest) if "=" in rest else (), "", blocks)
        if name not in _VOID and not rest.endswith("/"):
            places.setdefault(name, []).append(len(open_))
            if name in _SCOPE:
                scopes.append(len(open_))
            open_.append(node)
    if at < len(source):
        page.add(open_[-1], "", (), source[at:], blocks)
    return page


# --- features ------------------------------------------------------------------------

FEATURES = (
    "is_text group depth rest_tokens main_tokens inherited_rest inherited_main chars link_share tag_density"
    " children siblings place_among_siblings same_tag_siblings page_place page_share sentence_marks parent_group"
    " paragraphs heading_inside token_odds"
).split()


def features_of(page: Page, odds: dict[str, float]) -> np.ndarray:
    """One row of ``FEATURES`` for each node; ``odds`` of attribute tokens as learned."""
    n = len(page.parent)
    parent, tag = page.parent, page.tag
    chars, linked, nodes, marks = [0] * n, [0] * n, [1] * n, [0] * n
    paragraphs, headings, children = [0] * n, [0] * n, [0] * n
    rest, main, in_rest, in_main, depth, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    rank, before, seen_odds = [0] * n, [0] * n, [0.0] * n
    same: dict[tuple[int, str], int] = {}
    total = 0
    for i in range(n):
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            rank[i] = children[p]
            children[p] += 1
            same[p, tag[i]] = same.get((p, tag[i]), 0) + 1
            in_rest[i], in_main[i], in_link[i] = in_rest[p], in_main[p], in_link[p] or tag[i] == "a"
            seen_odds[i] = seen_odds[p]
        before[i] = total
        t = tag[i]
        if not t:
            size = len(page.text[i].strip())
            chars[i] = size
            linked[i] = size if in_link[i] else 0
            marks[i] = page.text[i].count(".") + page.text[i].count(",")
            total += size
            continue
        tokens = page.tokens[i]
        for token in tokens:
            rest[i] += token in _REST_TOKENS
            main[i] += token in _MAIN_TOKENS
            seen_odds[i] += odds.get(token, 0.0)
        rest[i] += t in _DECLARED_REST
        in_rest[i] += rest[i]
        in_main[i] += main[i] + (t in _DECLARED_MAIN)
        paragraphs[i], headings[i] = int(t == "p"), int(t in ("h1", "h2"))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for column in (chars, linked, nodes, marks, paragraphs, headings):
            column[p] += column[i]
    groups = [_GROUPS.get(t, 0) for t in tag]
    par = np.maximum(np.array(parent), 0)
    chars_, kids = np.array(chars, dtype=float), np.array(children, dtype=float)
    whole = max(1, total)
    safe = np.maximum(chars_, 1)
    group = np.array(groups, dtype=float)
    columns = [
        np.array([not t for t in tag], dtype=float),
        group,
        np.array(depth, dtype=float),
        np.array(rest, dtype=float),
        np.array(main, dtype=float),
        np.array(in_rest, dtype=float),
        np.array(in_main, dtype=float),
        np.log1p(chars_),
        np.array(linked) / safe,
        np.array(nodes) / (safe + 10),
        kids,
        kids[par],
        np.array(rank) / np.maximum(kids[par], 1),
        np.array([same.get((p, t), 1) for p, t in zip(parent, tag, strict=True)], dtype=float),
        np.array(before) / whole,
        chars_ / whole,
        np.array(marks) / safe,
        group[par],
        np.array(paragraphs, dtype=float),
        np.array(headings, dtype=float),
        np.array(seen_odds),
    ]
    return np.stack(columns, axis=1)


# --- boosted trees ----------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees of ``DEPTH`` levels, as arrays; a node goes right if above."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    odds: dict[str, float]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, odds: dict[str, float]) -> Trees:
    """Logistic boosting with Newton leaves and histogram splits."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    score = np.full(len(y), base)
    inner = 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            split = _best_split(bins[mine], grad[mine], hess[mine], cuts)
            if split:
                feature[node], threshold[node] = split
            at[mine] = 2 * node + 1 + (x[mine, feature[node]] > threshold[node])
        place = at - inner
        g = np.bincount(place, weights=grad, minlength=inner + 1)
        h = np.bincount(place, weights=hess, minlength=inner + 1)
        leaf = RATE * g / (h + 1.0)
        score += leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base, odds)


def _best_split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float] | None:
    if len(bins) < 2 * LEAST_ROWS:
        return None
    whole = grad.sum() ** 2 / (hess.sum() + 1)
    best, gain = None, 1e-6
    for f, cut in enumerate(cuts):
        k = len(cut)
        if not k:
            continue
        g = np.cumsum(np.bincount(bins[:, f], weights=grad, minlength=k + 1))[:-1]
        h = np.cumsum(np.bincount(bins[:, f], weights=hess, minlength=k + 1))[:-1]
        n = np.cumsum(np.bincount(bins[:, f], minlength=k + 1))[:-1]
        score = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - whole
        score[(n < LEAST_ROWS) | (len(bins) - n < LEAST_ROWS)] = 0
        i = int(np.argmax(score))
        if score[i] > gain:
            best, gain = (f, float(cut[i])), score[i]
    return best


# --- training -----------------------------------------------------------------------------


def declared(page: Page) -> np.ndarray | None:
    """1 for nodes that hold text the page itself declares as main; None if it has none."""
    n = len(page.parent)
    inside, out = [False] * n, [False] * n
    holds = np.zeros(n)
    for i in range(n):
        p = page.parent[i]
        if p >= 0:
            inside[i], out[i] = inside[p], out[p]
        inside[i] |= page.tag[i] in _DECLARED_MAIN or "mainstory" in page.tokens[i]
        out[i] |= page.tag[i] in _DECLARED_REST or any(t in _REST_TOKENS for t in page.tokens[i])
        holds[i] = float(not page.tag[i] and inside[i] and not out[i] and bool(page.text[i].strip()))
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] = max(holds[page.parent[i]], holds[i])
    return holds if holds[0] else None


def _planted(source: str, text: list[str], rng: random.Random) -> str:
    """A copy of a page with more boilerplate and, at times, without its declaring tags."""

    def words(lo: int, hi: int) -> str:
        return " ".join(rng.choices(text, k=rng.randint(lo, hi))) if text else "more"

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"

    def piece() -> str:
        token = rng.choice(sorted(_REST_TOKENS))
        name = rng.choice((token, f"site-{token}", f"{token}-box", f"main {token}", f"{token} text"))
        tag = rng.choice(("div", "section", "aside", "header", "form", "nav", "footer", "ul", "p"))
        inner = rng.choice((links, lambda: f"<p>{words(5, 60)}.</p>" * rng.randint(1, 3), lambda: words(2, 25)))()
        bare = tag in _DECLARED_REST and rng.random() < 0.5
        return f"<{tag}>{inner}</{tag}>" if bare else f'<{tag} {rng.choice(("class", "id"))}="{name}">{inner}</{tag}>'

    places = [m.start() for m in re.finditer(r"<p\b|<article\b|</article>|<footer\b|<nav\b|<h[1-6]\b", source, re.IGNORECASE)]
    for at in sorted(rng.sample(places, min(len(places), rng.randint(1, 6))), reverse=True):
        source = source[:at] + piece() + source[at:]
    if rng.random() < 0.5:
        name = rng.choice(("", "content", "post-body", "entry", "story", "text", "page", "wrap"))
        # the marker tells the labels where the main text is; its odds are not learned
        source = re.sub(r"<(article|main)\b[^>]*>", f'<div class="{name} mainstory">', source, flags=re.IGNORECASE)
        source = re.sub(r"</(article|main)\s*>", "</div>", source, flags=re.IGNORECASE)
    return source


def train(sources: Sequence[str], seed: int = 5) -> Trees | None:
    """Trees learned from pages that declare their main text, and planted copies of them."""
    rng = random.Random(seed)
    pages: list[tuple[Page, np.ndarray]] = []
    for source in sources:
        page = read_page(source)
        label = declared(page)
        if label is None:
            continue
        pages.append((page, label))
        text = [w for t in page.text for w in t.split()][:400]
        for _ in range(2):
            copy = read_page(_planted(source, text, rng))
            label = declared(copy)
            if label is not None:
                pages.append((copy, label))
    if not pages:
        return None
    counts: dict[str, list[float]] = {}
    for page, label in pages:
        for tokens, y in zip(page.tokens, label, strict=True):
            for token in set(tokens) - {"mainstory"}:
                have = counts.setdefault(token, [0.0, 0.0])
                have[int(y)] += 1
    odds = {t: float(np.log((b + 1) / (a + 1))) for t, (a, b) in counts.items() if a + b >= 3}
    x = np.concatenate([features_of(page, odds) for page, _ in pages])
    y = np.concatenate([label for _, label in pages])
    filled = np.concatenate([_filled(page) for page, _ in pages])
    return boosted(x[filled], y[filled], odds)


def _filled(page: Page) -> np.ndarray:
    """Nodes with text in their subtree; the others need no choice."""
    holds = [bool(not t and s.strip()) for t, s in zip(page.tag, page.text, strict=True)]
    for i in range(len(holds) - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    return np.array(holds)


#: Pages that may declare main text, the planted marker included.
_MAY_DECLARE = r"(?i)<(article|main)\b|mainstory"


def fit(pages: DataFrame, limit: int = TRAINING_PAGES) -> Trees | None:
    """Train on at most ``limit`` declaring pages of ``pages(page_id, html)``, which come to the driver.

    A tag may stand in a comment or hold nothing.  Where such pages leave the sample short,
    tasks read all pages with the tag and the sample is taken from those that declare.
    """
    short = pages.filter(f"char_length(html) BETWEEN 1 AND {TRAINING_CHARS}").select("page_id", "html")
    short = short.filter(F.col("html").rlike(_MAY_DECLARE)).withColumn("h", F.xxhash64("page_id", "html"))
    ids = short.select("page_id", "h")
    sources = _sampled(short, ids, limit)
    if len(sources) == limit and any(declared(read_page(s)) is None for s in sources):
        sources = _sampled(short, _declaring(short, ids), limit)
    return train(sources)


def _sampled(short: DataFrame, ids: DataFrame, limit: int) -> list[str]:
    sample = ids.orderBy("h", "page_id").limit(limit)
    met = short.join(F.broadcast(sample.select(F.col("h").alias("k")).distinct()), F.col("h") == F.col("k"))
    return [r["html"] for r in met.orderBy("k").limit(limit).collect()]


def _declaring(short: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``ids`` of the pages that do declare main text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [declared(read_page(h.as_py())) is not None for h in batch.column("html")]
            yield batch.select(["page_id", "h"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(short, scan, ids.schema)


# --- extraction ---------------------------------------------------------------------------


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """The most likely set of kept nodes that is closed under taking parents.

    A subtree is worth its root's log odds and what its children's subtrees are worth
    where that is positive; from the top down, subtrees of positive worth are kept.
    """
    worth = np.where(_filled(page), logit, 0.0).tolist()
    for i in range(len(worth) - 1, 0, -1):
        if worth[i] > 0:
            worth[page.parent[i]] += worth[i]
    kept = [w > 0 for w in worth]
    for i in range(1, len(kept)):
        kept[i] = kept[i] and kept[page.parent[i]]
    return kept


def kept_text(page: Page, kept: Sequence[bool]) -> str:
    parts: list[str] = []
    block = -1
    for i, keep in enumerate(kept):
        if keep and not page.tag[i]:
            if page.block[i] != block:
                parts.append(" ")
            block = page.block[i]
            parts.append(page.text[i])
    return " ".join(references.unescape("".join(parts)).split())


def extracted(pages: DataFrame, model: Trees | None) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages(page_id, url, html)``.

    Without a model (no page of the sample declares main text) all visible text is kept.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees | None = shared.value
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 64):
                read = [read_page(h or "") for h in batch.column("html").slice(at, 64).to_pylist()]
                if trees is None:
                    texts += [kept_text(p, [True] * len(p.parent)) for p in read]
                    continue
                x = [features_of(p, trees.odds) for p in read]
                logit = trees.logit(np.concatenate(x))
                ends = np.cumsum([len(f) for f in x])
                texts += [kept_text(p, decode(p, logit[e - len(f) : e])) for p, f, e in zip(read, x, ends, strict=True)]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_batches(rows, scan, "page_id BIGINT, url STRING, text STRING")
