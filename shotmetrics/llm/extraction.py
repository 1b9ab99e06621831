"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

Each block element is described by its subtree's density, its attribute tokens,
its depth and its siblings. Boosted trees give the odds that it is content. A
page is then decoded as a whole: a node is kept with all below it, dropped with
all below it, or left mixed, so no choice contradicts one above or below it.

Nobody has labelled the pages. The trees learn from pages whose article stands
in an article or main element: their blocks are set anew in random layouts with
other elements and names, beside menus, adverts, notices, forms, side bars and
reader comments made from other pages' blocks, where each block's label is known.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .dom import BLOCKS, Page

# Bounds of the fit: pages of the sample, characters of a page in it, layouts of each.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 50_000
LAYOUTS = 6
BATCH = 256
# What a mixed node costs, in weighted log odds.
MIXED = 2.0

# Beginnings of class, id and role names that tell a block's part.
TOKENS = {
    "content": ["content", "article", "post", "entry", "story", "main", "text", "body", "prose", "copy"],
    "menu": ["nav", "menu", "breadcrumb", "crumb", "toc", "tabs", "pagination", "pager", "topbar", "toolbar", "skip"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "teaser", "outbrain", "taboola"],
    "frame": ["footer", "foot", "header", "masthead", "copyright", "legal", "colophon", "contentinfo", "branding", "logo"],
    "side": ["sidebar", "side", "aside", "related", "widget", "rail", "recommended", "popular", "trending", "complementary", "more"],
    "comment": ["comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "feedback", "reader"],
    "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "dialog", "warning", "paywall"],
    "form": ["form", "newsletter", "subscribe", "signup", "search", "login", "contact", "register", "poll"],
    "share": ["share", "sharing", "social", "tags", "meta", "byline", "author", "follow", "tools"],
}
_WHOLE = {"ad", "ads", "more", "side", "text", "main", "body", "copy", "foot", "form", "tags", "meta", "rail", "toc", "post", "nav"}
_KINDS = list(TOKENS)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_GROUPS = [
    ["p"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["li", "dt", "dd"], ["ul", "ol", "dl", "menu"], ["td", "th", "tr", "table", "tbody"],
    ["div", "center"], ["section"], ["article"], ["main"], ["nav", "menu"], ["header", "hgroup"], ["footer", "address"], ["aside"],
    ["form", "fieldset", "label", "legend", "search"], ["blockquote", "pre"], ["figure", "figcaption"], ["dialog", "details", "summary"],
]
_GROUP_OF = np.array([next((g for g, tags in enumerate(_GROUPS) if tag in tags), len(_GROUPS)) for tag in BLOCKS])
_P = BLOCKS.index("p")
_PAGE_FRAMES = {BLOCKS.index("html"), BLOCKS.index("body")}


def name_kinds(names: str) -> list[int]:
    """Which kinds the attribute tokens of an element belong to, in the order of TOKENS."""
    parts = [p.lower() for p in _SPLIT.findall(names)]
    return [int(any(p == t or t not in _WHOLE and len(t) > 3 and p.startswith(t) for p in parts for t in words)) for words in TOKENS.values()]


def _raise(values: np.ndarray, parents: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sums over subtrees; order lists the nodes' positions by depth, deepest first."""
    total = values.astype(float).copy()
    for layer in order:
        np.add.at(total, parents[layer], total[layer])
    return total


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of the pages, in order."""
    sizes = [len(p.tags) for p in pages]
    base = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    n = len(base)
    page = np.repeat(np.arange(len(pages)), sizes)
    tags = np.concatenate([p.tags for p in pages]).astype(int)
    local = np.concatenate([p.parents for p in pages]).astype(int)
    root = local < 0
    parents = np.where(root, np.arange(n), local + base)
    depth = np.zeros(n, int)
    kinds_of: dict[str, list[int]] = {"": [0] * len(_KINDS)}
    kinds = np.zeros((n, len(_KINDS)))
    at = 0
    for p in pages:
        for name in p.names:
            if name:
                found = kinds_of.get(name)
                if found is None:
                    found = kinds_of[name] = name_kinds(name)
                kinds[at] = found
            at += 1
    own = np.zeros((n, 5))
    start = 0
    for p in pages:
        for node, _, text, link in p.pieces:
            words = text.count(" ") + 1
            if words > 1 or not text.isspace():
                row = own[start + node]
                row[0] += len(text)
                row[1] += words
                row[2] += len(text) if link else 0
                row[3] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                row[4] += link
        start += len(p.tags)
    above = kinds.copy()
    group = np.eye(len(_GROUPS) + 1)[_GROUP_OF[tags]]
    group_above = group.copy()
    # Parents stand before children, so one walk by depth is enough.
    pending = np.flatnonzero(~root)
    layers: list[np.ndarray] = []
    ready = root.copy()
    while len(pending):
        layer = pending[ready[parents[pending]]]
        depth[layer] = depth[parents[layer]] + 1
        above[layer] = np.maximum(above[layer], above[parents[layer]])
        group_above[layer] = np.maximum(group_above[layer], group_above[parents[layer]])
        ready[layer] = True
        layers.append(layer)
        pending = pending[~ready[pending]]
    order = layers[::-1]
    chars, words, linked, stops, links = (_raise(own[:, i], parents, order) for i in range(5))
    below = _raise(np.ones(n), parents, order)
    paragraphs = _raise((tags == _P).astype(float), parents, order)
    inner_kinds = np.column_stack([_raise(kinds[:, i], parents, order) for i in range(len(_KINDS))]) > 0
    child_count = np.bincount(parents[~root], minlength=n)
    child_words = np.bincount(parents[~root], words[~root], minlength=n)
    siblings = child_count[parents]
    first = np.zeros(n)
    rank = np.zeros(n)
    seen: dict[int, int] = {}
    for i, parent in enumerate(parents.tolist()):
        if not root[i]:
            rank[i] = seen.get(parent, 0)
            seen[parent] = seen.get(parent, 0) + 1
    first[:] = rank / np.maximum(siblings, 1)
    page_words = words[np.flatnonzero(root)][page]
    before = np.cumsum(own[:, 1]) - own[:, 1]
    before = (before - before[np.flatnonzero(root)][page]) / np.maximum(page_words, 1)
    density = linked / np.maximum(chars, 1)
    per_block = words / below
    mean_sibling = (child_words[parents] - words) / np.maximum(siblings - 1, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, parents, own[:, 1])
    columns = [
        np.log1p(chars), np.log1p(words), np.log1p(own[:, 1]), density, stops / np.maximum(words, 1), np.log1p(below), per_block,
        np.log1p(paragraphs), words / np.maximum(page_words, 1), depth, siblings, first, before, np.log1p(mean_sibling),
        density[parents], per_block[parents], np.log1p(longest), links / np.maximum(words, 1), np.log1p(chars[parents]),
    ]
    return np.column_stack([*columns, kinds, above, inner_kinds, group, group_above])


def decoded(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes' own text is kept: the best tree of keep-all, drop-all and mixed nodes."""
    n = len(page.tags)
    has_text = [0.0] * n
    for node, _, text, _ in page.pieces:
        if not text.isspace():
            has_text[node] += len(text)
    parents = page.parents
    # Frames of the page say nothing of themselves; other boxes little, texts more.
    weight = [0.3 + np.log1p(t) if t else 0.0 if tag in _PAGE_FRAMES else 0.3 for t, tag in zip(has_text, page.tags, strict=True)]
    yes = [0.0] * n
    no = [0.0] * n
    free = [0.0] * n
    for v in range(n - 1, -1, -1):
        p = 1 / (1 + np.exp(-max(-12.0, min(12.0, odds[v]))))
        good, bad = weight[v] * np.log(p), weight[v] * np.log(1 - p)
        if page.marks[v] == "hidden":
            good = -1e9
        yes[v] += good
        no[v] += bad
        # A mixed node says nothing of itself; its own text, if any, goes by its own odds.
        free[v] += max(good, bad) - MIXED if has_text[v] else -MIXED * (page.tags[v] not in _PAGE_FRAMES)
        if v:
            up = parents[v]
            yes[up] += yes[v]
            no[up] += no[v]
            free[up] += max(yes[v], no[v], free[v])
    keep = [False] * n
    state = [0] * n
    for v in range(n):
        above = state[parents[v]] if v else 0
        if above:
            state[v] = above
        else:
            best = max(yes[v], no[v], free[v])
            state[v] = 1 if best == yes[v] else -1 if best == no[v] else 0
        keep[v] = state[v] == 1 or state[v] == 0 and has_text[v] > 0 and odds[v] > 0 and page.marks[v] != "hidden"
    return keep


# ---- layouts of the sample ----

_TEXTS = {
    "menu": ["Home", "News", "About", "Contact", "Archive", "Sport", "Culture"],
    "share": ["Share", "Tweet", "Print", "Email", "Save"],
}


def sample_blocks(source: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The article's blocks (tag, text) and the other texts of a page; no blocks if nothing marks the article."""
    page = Page(source)
    inside = [False] * len(page.tags)
    for v, parent in enumerate(page.parents):
        tag = BLOCKS[page.tags[v]]
        inside[v] = tag in ("article", "main") or parent >= 0 and inside[parent] and tag not in ("nav", "aside", "footer", "form", "header")
    blocks: list[tuple[str, str]] = []
    others: list[str] = []
    last = None
    for node, run, text, _ in page.pieces:
        text = " ".join(text.split())
        if not text:
            continue
        if not inside[node]:
            others.append(text)
        elif run == last:
            blocks[-1] = blocks[-1][0], f"{blocks[-1][1]} {text}"
        else:
            blocks.append((BLOCKS[page.tags[node]], text))
            last = run
    return blocks, others


def layout(rng: random.Random, blocks: list[tuple[str, str]], others: list[str], prose: list[str]) -> str:
    """A page in a random layout; data-y marks what is content (1) and what is not (0)."""
    esc = html.escape

    def words(count: int) -> str:
        text = rng.choice(prose).split()
        begin = rng.randrange(max(1, len(text) - count))
        return esc(" ".join(text[begin : begin + count]))

    def named(kind: str, chance: float = 0.8) -> str:
        if rng.random() > chance:
            return rng.choice(["", "", ' class="box"', ' class="c12"', ' id="x1"', ' class="row"'])
        word = rng.choice(TOKENS[kind])
        extra = rng.choice(["", "", "-wrap", "-box", "-inner", "_1", "-list"])
        return f' {rng.choice(["class", "id", "class"])}="{rng.choice(["", "", "site-", "page-"])}{word}{extra}"'

    def link_list(kind: str, items: int) -> str:
        tag = rng.choice(["nav", "ul", "div", "div", "header"]) if kind == "menu" else rng.choice(["div", "aside", "section", "ul"])
        entry = [f'<a href="/{i}">{words(rng.randint(1, 2 if kind == "menu" else 9))}</a>' for i in range(items)]
        style = rng.randrange(3)
        if style == 0 or tag == "ul":
            body = "".join(f"<li>{e}</li>" for e in entry)
            body = body if tag == "ul" else f"<ul>{body}</ul>"
        else:
            body = (" | " if style == 1 else " ").join(entry)
        title = f"<h3>{words(2)}</h3>" if kind != "menu" and tag != "ul" and rng.random() < 0.6 else ""
        return f'<{tag}{named(kind)} data-y="0">{title}{body}</{tag}>'

    def advert() -> str:
        tag = rng.choice(["div", "aside", "section", "p", "div"])
        text = esc(rng.choice(others)) if others and rng.random() < 0.5 else words(rng.randint(3, 25))
        return f'<{tag}{named("advert", 0.95)} data-y="0">{text}</{tag}>'

    def notice() -> str:
        tag = rng.choice(["div", "section", "dialog", "p"])
        body = words(rng.randint(6, 40))
        body = f"<p>{body}</p>" if tag != "p" and rng.random() < 0.5 else body
        return f'<{tag}{named("notice", 0.95)} data-y="0">{body}<button>OK</button></{tag}>'

    def form() -> str:
        tag = rng.choice(["form", "form", "div"])
        return f'<{tag}{named("form", 0.95 if tag == "div" else 0.6)} data-y="0"><label>{words(2)}</label><input name=q><p>{words(rng.randint(3, 14))}</p></{tag}>'

    def footer() -> str:
        tag = rng.choice(["footer", "footer", "div", "div", "p"])
        text = f"&copy; {words(2)} &middot; {esc(rng.choice(others)) if others else words(8)}"
        text = f"<p>{text}</p>" if tag != "p" and rng.random() < 0.5 else text
        return f'<{tag}{named("frame", 0.9 if tag != "footer" else 0.4)} data-y="0">{text}</{tag}>'

    def header() -> str:
        tag = rng.choice(["header", "div"])
        return f'<{tag}{named("frame", 0.9 if tag == "div" else 0.4)} data-y="0"><{rng.choice(["h1", "p", "div"])}>{words(3)}</{"div"}><p>{words(6)}</p></{tag}>'

    def comments() -> str:
        entry_tag, style = rng.choice(["li", "div", "li", "div", "article"]), rng.randrange(2)
        entries = ""
        for _ in range(rng.randint(1, 6)):
            body = "".join(f"<p>{words(rng.randint(4, 60))}</p>" for _ in range(rng.randint(1, 2)))
            entries += f'<{entry_tag}{named("comment", 0.7)}><{"cite" if style else "span"}>{words(2)}</{"cite" if style else "span"}> {body}</{entry_tag}>'
        entries = f"<ol>{entries}</ol>" if entry_tag == "li" else entries
        return f'<{rng.choice(["section", "div"])}{named("comment", 0.97)} data-y="0"><h3>{words(2)}</h3>{entries}</div>'

    def share() -> str:
        return f'<div{named("share", 0.9)} data-y="0">' + " ".join(f'<a href="#">{t}</a>' for t in _TEXTS["share"][: rng.randint(2, 5)]) + "</div>"

    def side() -> str:
        if rng.random() < 0.5:
            return link_list("side", rng.randint(3, 9))
        tag = rng.choice(["aside", "div", "td"])
        return f'<{tag}{named("side", 0.9 if tag != "aside" else 0.5)} data-y="0"><h4>{words(2)}</h4><p>{words(rng.randint(5, 50))}</p></{tag}>'

    if rng.random() < 0.3:
        blocks = [(t, x if rng.random() < 0.5 else " ".join(x.split()[: rng.randint(2, 12)])) for t, x in blocks[: rng.randint(1, 4)]]
    body = []
    for i, (tag, text) in enumerate(blocks):
        tag = tag if tag in ("h1", "h2", "h3", "li", "blockquote", "pre") else rng.choice(["p", "p", "p", "p", "div"])
        if tag == "p" and rng.random() < 0.05:
            tag = rng.choice(["blockquote", "h2", "pre"])
        inner = esc(text, quote=False)
        if rng.random() < 0.15:
            parts = inner.split(" ")
            spot = rng.randrange(len(parts))
            parts[spot] = f'<a href="/w">{parts[spot]}</a>'
            inner = " ".join(parts)
        close = "" if tag == "p" and rng.random() < 0.1 else f"</{tag}>"
        body.append(f'<{tag} data-y="1">{inner}{close}')
        if i and rng.random() < 0.04:
            body.append(rng.choice([advert, share, form, side])())
    if rng.random() < 0.3:
        body.insert(rng.randint(0, 1), share())
    if rng.random() < 0.25:
        body.append(rng.choice([comments, share, lambda: link_list("side", 4)])())
    inner = "".join(body)
    tag = rng.choice(["article", "article", "main", "div", "div", "div", "section", "td"])
    inner = f"<{tag}{named('content', 0.6 if tag in ('div', 'td', 'section') else 0.3)}>{inner}</{tag}>"
    for _ in range(rng.randint(0, 3)):
        tag = rng.choice(["div", "div", "section", "main"])
        inner = f"<{tag}{named('content', 0.3)}>{inner}</{tag}>"
    top = [f() for f in (header, lambda: link_list("menu", rng.randint(3, 9)), notice, advert, lambda: link_list("menu", 3)) if rng.random() < 0.5]
    end = [f() for f in (side, comments, advert, form, footer, lambda: link_list("side", rng.randint(3, 8)), notice) if rng.random() < 0.45]
    rng.shuffle(top)
    tail = end[-1:] if rng.random() < 0.3 else []
    return f"<html><head><title>{words(4)}</title></head><body>{''.join(top)}{inner}{''.join(end)}{''.join(tail)}</body></html>"


def labelled_nodes(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Nodes whose text is all content (1) or all not (0), and their labels."""
    n = len(page.tags)
    mark = [None] * n
    for v in range(n):
        own = page.marks[v]
        mark[v] = int(own) if own in ("0", "1") else mark[page.parents[v]] if v else None
    low, high = [2] * n, [-1] * n
    for node, _, text, _ in page.pieces:
        if not text.isspace() and mark[node] is not None:
            low[node] = min(low[node], mark[node])
            high[node] = max(high[node], mark[node])
    for v in range(n - 1, 0, -1):
        up = page.parents[v]
        low[up], high[up] = min(low[up], low[v]), max(high[up], high[v])
    pure = np.array([v for v in range(1, n) if low[v] == high[v]], int)
    return pure, np.array([low[v] for v in pure], float)


def fit(pages: DataFrame, seed: int = 5, sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> BoostedTrees | None:
    """Trees from a bounded sample of pages, by a hash of their text; None if no page marks its article."""
    marked = pages.filter((F.length("html") <= SAMPLE_CHARS) & F.lower("html").rlike("<(article|main)[\\s>]"))
    hashed = marked.select("html", F.xxhash64("html").alias("hash"))
    # Numbers are ranked, so that only the pages of the sample come to the driver; copies count once.
    least = [r["hash"] for r in hashed.select("hash").distinct().orderBy("hash").limit(sample).collect()]
    chosen = hashed.filter(F.col("hash").isin(least)).groupBy("hash").agg(F.min("html").alias("html")).orderBy("hash").collect()
    split = [sample_blocks(r["html"]) for r in chosen]
    split = [s for s in split if s[0]]
    if not split:
        return None
    rng = random.Random(seed)
    prose = [text for blocks, _ in split for _, text in blocks]
    xs, ys, ws = [], [], []
    for blocks, others in split:
        made = [Page(layout(rng, blocks, others, prose)) for _ in range(layouts)]
        x = features(made)
        start = 0
        for page in made:
            nodes, labels = labelled_nodes(page)
            xs.append(x[start + nodes])
            ys.append(labels)
            ws.append(np.full(len(nodes), 1.0))
            start += len(page.tags)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def _plain_odds(x: np.ndarray) -> np.ndarray:
    """Without a model: long blocks with few links are content."""
    return np.where((x[:, 3] < 0.3) & (x[:, 1] > np.log1p(8)), 2.0, -2.0)


def main_texts(sources: list[str], model: BoostedTrees | None) -> list[str]:
    pages = [Page(s) for s in sources]
    x = features(pages)
    odds = model.log_odds(x) if model else _plain_odds(x)
    out, start = [], 0
    for page in pages:
        out.append(page.text(decoded(page, odds[start : start + len(page.tags)])))
        start += len(page.tags)
    return out


def extracted(spark: SparkSession, pages: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """Per row: page_id, url and text.

    Null and empty pages give the empty text, and so do pages without content.
    Character references are decoded, white space inside a block is one space,
    and blocks are joined in page order by one space. Rows are read where they
    lie; repeated rows give repeated results, an empty table an empty one, and
    other columns are ignored. Without a model, which needs pages that mark
    their article, long blocks with few links are taken.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = pickle.loads(sent.value)
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                texts = main_texts(list(part["html"]), trees)
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64").array, "url": pd.Series(list(part["url"]), dtype=object), "text": pd.Series(texts, dtype=object)})

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id bigint, url string, text string")
