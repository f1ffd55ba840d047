"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements, with its runs of text as leaves. Every node is content or not. A node's potential sums
weights of its features (tag, words of class, id and role; for text its length, share of links, punctuation and place); an edge's potential
ties parent and child, apart for elements and for text. Sum-product messages go upward, then downward, and give every node's marginal;
texts of marginal 0.5 or more are the main text. Weights follow the exact gradient of the likelihood on labelled pages.

Labelled pages are made here from a seed: layouts with menus, headers, sidebars, notices, adverts, forms, comments and footers around an
article, so that neither length nor wording tells content, but structure does. Others can be given to `fit`.

Null and empty pages have an empty text. Markup of any kind is read (unclosed, misnested or cut off); what scripts, styles and the like
hold isn't text. Pages are read whole.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import map_arrow

#: Size of the hashed weight table; pages and rounds of the fit.
WEIGHTS, FIT_PAGES, FIT_ROUNDS = 1 << 14, 500, 80

# Kinds of HTML elements.
SKIPPED = frozenset("script style noscript template textarea select button svg iframe object canvas audio video math head title datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CASES = re.compile(r"([a-z])([A-Z])")


@dataclass
class Tree:
    """Nodes in page order: parent (-1: root), depth, hashed features, and the text of leaves (None: an element)."""

    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WEIGHTS


_HASHES: dict[str, int] = {}


def _feature(name: str) -> int:
    if name not in _HASHES:
        if len(_HASHES) > 100_000:
            _HASHES.clear()
        _HASHES[name] = _hash(name)
    return _HASHES[name]


def _names(attributes: str) -> list[str]:
    """Lower-cased words of class, id and role."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        found += _WORDS.findall(_CASES.sub(r"\1 \2", value).lower())[:12]
    return found


def parse(page: str) -> Tree:
    """The tree of a page's blocks and texts."""
    tree, stack, tags = Tree(), [], []
    run: list[str] = []
    linked = [0, 0]  # characters within links; open links
    # How many elements of a tag are open; for each open element, the paragraph that a block would close (-1: none); tags without a further end.
    opened: Counter[str] = Counter()
    closable: list[int] = []
    endless: set[str] = set()

    def node(tag: str, names: list[str]) -> None:
        parent = stack[-1] if stack else -1
        features = [f"t {tag}", f"u {tags[-1] if tags else ''} {tag}", *(f"c {n}" for n in names), *(f"d {tag} {n}" for n in names)]
        if not names:
            features.append("c")
        tree.parents.append(parent)
        tree.depths.append(len(stack))
        tree.features.append([_feature(x) for x in dict.fromkeys(features)])
        tree.texts.append(None)
        stack.append(len(tree.parents) - 1)
        closable.append(len(tags) if tag == "p" else -1 if not tags or tag in ("td", "th", "button") else closable[-1])
        tags.append(tag)
        opened[tag] += 1

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                if not stack:
                    node("body", [])
                size, share = len(text), linked[0] / max(1, sum(map(len, run)))
                marks = sum(text.count(c) for c in ".,;:!?")
                features = ["x", f"xt {tags[-1]}", f"xs {min(8, size.bit_length())}", f"xl {min(4, int(share * 5))}", f"xm {min(4, marks)}", f"xe {text[-1] in '.!?…'}", f"xc {'©' in text}", f"xn {any(opened[tag] for tag in ('nav', 'footer', 'aside', 'form', 'header'))}"]
                tree.parents.append(stack[-1])
                tree.depths.append(len(stack))
                tree.features.append([_feature(x) for x in features])
                tree.texts.append(text)
            run.clear()
        linked[0] = 0

    def close(upto: int) -> None:
        flush()
        linked[1] = 0
        opened.subtract(tags[upto:])
        del stack[upto:], tags[upto:], closable[upto:]

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            run.append(page[at : m.start()])
            if linked[1]:
                linked[0] += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                linked[1] = 0
            elif tag in BLOCKS and opened[tag]:
                close(next(k for k in range(len(tags) - 1, -1, -1) if tags[k] == tag))
            elif tag == "p":
                flush()
            continue
        if tag in SKIPPED:
            if not m[3].rstrip().endswith("/") or tag != "svg":
                end = None if tag in endless else re.compile(rf"</{tag}\s*>|</{tag}\b[^>]*>", re.I).search(page, at)
                if not end:
                    endless.add(tag)
                at = end.end() if end else len(page) if tag not in ("head", "title", "button", "select") else at
            run.append(" ")
        elif tag == "a":
            linked[1] = 1
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag == "hr":
                continue
            if tags and closable[-1] >= 0 and tag not in ("html", "body"):
                close(closable[-1])
            if tag in CLOSES:
                for k in range(len(tags) - 1, -1, -1):
                    if tags[k] in SCOPES[tag]:
                        break
                    if tags[k] in CLOSES[tag]:
                        close(k)
                        break
            if tag in ("html", "body") and opened[tag]:
                continue
            node(tag, _names(m[3]))
        # Other elements are inline: they part no text and are no nodes.
    run.append(page[at:])
    flush()
    return tree


class Forest:
    """Many trees as arrays, for messages by depth."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.parents) for t in trees]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        offset = np.repeat(self.starts[:-1], sizes)
        parents = np.fromiter((p for t in trees for p in t.parents), np.int64, int(self.starts[-1]))
        self.parents = np.where(parents < 0, -1, parents + offset)
        self.depths = np.fromiter((d for t in trees for d in t.depths), np.int64, len(parents))
        features = [f for t in trees for f in t.features]
        self.owners = np.repeat(np.arange(len(features)), [len(f) for f in features])
        self.features = np.fromiter((x for f in features for x in f), np.int64, len(self.owners))
        self.kinds = np.fromiter((int(x is not None) for t in trees for x in t.texts), np.int64, len(parents))
        order = np.argsort(self.depths, kind="stable")
        cuts = np.searchsorted(self.depths[order], np.arange(1, (self.depths.max() if len(order) else 0) + 2))
        self.levels = [x for x in np.split(order, cuts) if len(x)]


@dataclass
class Model:
    weights: np.ndarray  # by feature
    edges: np.ndarray  # [element or text, parent's state, child's state]

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content by node, and of both states by edge to the parent."""
        n = len(forest.parents)
        unary = np.zeros((n, 2))
        unary[:, 1] = np.bincount(forest.owners, self.weights[forest.features], n)
        up, to_parent = unary.copy(), np.zeros((n, 2))
        for level in reversed(forest.levels[1:]):
            to_parent[level] = np.logaddexp.reduce(up[level][:, None, :] + self.edges[forest.kinds[level]], axis=2)
            np.add.at(up, forest.parents[level], to_parent[level])
        belief, pair = up.copy(), np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            rest = belief[forest.parents[level]] - to_parent[level]
            joint = rest[:, :, None] + self.edges[forest.kinds[level]] + up[level][:, None, :]
            belief[level] = np.logaddexp.reduce(joint, axis=1)
            pair[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def fit(pages: list[tuple[str, set[str]]], rounds: int = FIT_ROUNDS) -> Model:
    """Fits a model on pages and the texts of each that are content. An element is content if at least half of its text is."""
    trees = [parse(page) for page, _ in pages]
    forest = Forest(trees)
    goal = []
    for tree, (_, content) in zip(trees, pages, strict=True):
        good, size = np.zeros(len(tree.parents)), np.zeros(len(tree.parents))
        for k in range(len(tree.parents) - 1, -1, -1):
            if (text := tree.texts[k]) is not None:
                size[k], good[k] = len(text), len(text) * (text in content)
            if tree.parents[k] >= 0:
                size[tree.parents[k]] += size[k]
                good[tree.parents[k]] += good[k]
        goal.append((good * 2 >= size) & (size > 0))
    y = np.concatenate(goal).astype(int)
    model = Model(np.zeros(WEIGHTS), np.zeros((2, 2, 2)))
    squares, edge_squares = np.full(WEIGHTS, 1e-4), np.full((2, 2, 2), 1e-4)
    child = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kinds[child], y[forest.parents[child]], y[child]), 1)
    for _ in range(rounds):
        p, pair = model.marginals(forest)
        step = np.bincount(forest.features, (y - p)[forest.owners], WEIGHTS) / len(pages) - 0.002 * model.weights
        squares += step * step
        model.weights += 0.3 * step / np.sqrt(squares)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.kinds[child], pair[child])
        edge_step = (seen - expected) / len(pages) - 0.002 * model.edges
        edge_squares += edge_step * edge_step
        model.edges += 0.3 * edge_step / np.sqrt(edge_squares)
    return model


# Names that public page layouts give to what isn't the article, and to what is.
_ASIDE = {
    "nav": "nav navbar navigation menu mainmenu breadcrumb breadcrumbs topbar toc pagination pager tabs",
    "header": "header masthead branding site logo top banner hero tagline",
    "footer": "footer bottom copyright legal colophon imprint",
    "aside": "sidebar aside widget related recommended popular trending recent tags archive rail secondary",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox banner dfp google",
    "notice": "notice cookie consent gdpr alert popup modal overlay message warning disclaimer subscribe newsletter paywall",
    "form": "form search login signup subscribe contact poll",
    "comments": "comments comment reply respond discussion thread disqus reader reviews",
    "share": "share social sharing follow buttons toolbar meta byline",
}
_MAIN = "article post entry content main story body text page single blog news hentry prose markdown".split()


def labelled_pages(count: int = FIT_PAGES, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Pages of random layouts and the texts of each that are content."""
    rng = random.Random(seed)
    letters = "aaeeiioouubcdfghklmnprstvwzéüñ"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def prose(least: int, most: int) -> str:
        n = rng.randint(least, most)
        out = " ".join(word() + rng.choice(["", "", "", "", "", ","]) for _ in range(n)).rstrip(",")
        return out.capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def names(pool: list[str], tag: str) -> str:
        if tag not in ("div", "section", "span", "ul", "p", "td") and rng.random() < 0.45:
            return ""
        chosen = rng.sample(pool, min(len(pool), rng.choice([1, 1, 2])))
        value = rng.choice(["-", " ", "_"]).join(chosen + ([rng.choice(["wrap", "inner", "box", "block", "area", "container", "1", "list"])] if rng.random() < 0.3 else []))
        return f' {rng.choice(["class", "class", "id"])}="{value}"'

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{prose(1, 3)}</a>' for _ in range(n)]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if rng.random() < 0.7 else " | ".join(items)

    def boiler(kind: str) -> str:
        own = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "div"], "form": ["form", "form", "div"], "comments": ["section", "div"]}.get(kind, ["div", "div", "section", "aside", "p"])
        tag = rng.choice(own)
        inner = {
            "nav": lambda: links(rng.randint(2, 9)),
            "header": lambda: rng.choice([f"<h1>{prose(1, 4)}</h1>", f"<div>{prose(1, 5)}</div>", f"<p>{prose(2, 8)}</p>", links(3)]) + rng.choice(["", f"<p>{prose(2, 9)}</p>"]),
            "footer": lambda: rng.choice([f"&copy; {word()}.{word()}.com &middot; {prose(3, 14)}", f"<p>&copy; {prose(2, 20)}</p>", f"{prose(3, 20)}", links(4) + f"<p>{prose(2, 12)}</p>"]),
            "aside": lambda: f"<h3>{prose(1, 3)}</h3>" + rng.choice([links(rng.randint(2, 6)), f"<p>{prose(4, 40)}</p>"]),
            "form": lambda: f'<label>{prose(1, 4)}</label><input name="q"><p>{prose(2, 18)}</p><button>{word()}</button>',
            "comments": lambda: f"<h3>{prose(1, 3)}</h3>" + "".join(f"<div{names(_ASIDE['comments'].split(), 'div')}><b>{word()}</b><p>{prose(3, 60)}</p></div>" for _ in range(rng.randint(1, 4))),
        }.get(kind, lambda: rng.choice([prose(3, 40), f"<p>{prose(3, 40)}</p>", f"<a href='/x'>{prose(2, 8)}</a>"]))()
        return f"<{tag}{names(_ASIDE[kind].split(), tag)}>{inner}</{tag}>"

    out = []
    for _ in range(count):
        content: set[str] = set()

        def keep(text: str, content: set[str] = content) -> str:
            content.add(text)
            return text

        parts = [f"<h1>{keep(prose(1, 10))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                broken = rng.random()
                text = keep(prose(1, 70))
                parts.append(f"<p><b>{text}<br>" if broken < 0.12 else f"<p>{text}" if broken < 0.2 else f"<p>{text}</p>")
            elif kind < 0.82:
                parts.append(f"<h{rng.choice('234')}>{keep(prose(1, 7))}</h2>" if rng.random() < 0.1 else f"<h2>{keep(prose(1, 7))}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{keep(prose(1, 15))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote>{keep(prose(3, 30))}</blockquote>")
            else:
                parts.append(boiler(rng.choice(["ad", "share", "aside", "notice"])))
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        main = "".join(parts) if rng.random() < 0.12 else f"<{tag}{names(_MAIN, tag)}>{''.join(parts)}</{tag}>"
        for _ in range(rng.choice([0, 0, 1])):
            wrap = rng.choice(["main", "div", "section"])
            main = f"<{wrap}{names(_MAIN, wrap)}>{main}{boiler(rng.choice(['comments', 'aside', 'share'])) if rng.random() < 0.5 else ''}</{wrap}>"
        before = [boiler(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "nav", "ad"], rng.randint(0, 4))]
        after = [boiler(k) for k in rng.sample(["aside", "comments", "ad", "form", "share", "notice"], rng.randint(0, 3))] + ([boiler("footer")] if rng.random() < 0.85 else [])
        head = f"<head><title>{prose(2, 8)}</title><style>p{{margin:0}}</style></head>" if rng.random() < 0.8 else ""
        out.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{main}{''.join(after)}</body></html>", content))
    return out


_FITTED: list[Model] = []


def fitted() -> Model:
    """The model of the labelled pages made here; fitted once in a process."""
    if not _FITTED:
        _FITTED.append(fit(labelled_pages()))
    return _FITTED[0]


def texts_of(pages: list[str], model: Model) -> list[str]:
    """The main text of each page: its content blocks in page order, joined by blank lines."""
    trees = [parse(p) for p in pages]
    forest = Forest(trees)
    p = model.marginals(forest)[0] if len(forest.parents) else np.zeros(0)
    return ["\n\n".join(t for t, q in zip(tree.texts, p[start:], strict=False) if t is not None and q >= 0.5) for tree, start in zip(trees, forest.starts, strict=False)]


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model or fitted())  # 128 KB of weights
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, `{url_col}` {rows.schema[url_col].dataType.simpleString()}, text string, n_chars long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = [h or "" for h in batch.column(2).to_pylist()]
        texts = [t for k in range(0, len(pages), 500) for t in texts_of(pages[k : k + 500], held.value)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return map_arrow(rows, run, schema)
