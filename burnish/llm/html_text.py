"""HTML extraction: boosted trees judge DOM nodes, decoding keeps the tree consistent.

A page becomes a tree of its block elements and stray text blocks. Each node has
features of its subtree, its attribute tokens, its depth and its siblings, and the
trees give the log odds that it holds main text. A node can be kept only if its parent
is, so the best consistent choice is found bottom-up: a node's gain is its log odds plus
the positive gains of its children, and a dropped node takes its subtree along.

No page table has labels, so the trees learn from pages that a generator lays out in
many ways and labels as it writes them (``page_maker``); that takes seconds.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.boosting import Boosted, train

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements whose text is no text of the page if their end tag is there; without one they are like any other.
MUTE = frozenset("svg select button template".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary hr center dialog menu".split()
)
#: Elements that an opening tag of these closes if they are open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Block elements that may lack an end tag.
UNENDED = frozenset("p li dt dd thead tbody tfoot tr td th hr".split())
#: Those inside which the search for them ends.
SCOPE = frozenset("ul ol dl table body html".split())

#: An attribute of made pages only, see page_maker.
MAIN_MARK = "data-main"

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:\b(?:class|id|role|aria-label|itemprop)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Attribute tokens, by what they tend to mark.
SIGNS = {
    "main": "article content contents post entry main body story text page prose blog news paragraph",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc tabs toolbar skip",
    "top": "header head masthead banner topbar branding logo",
    "end": "footer foot copyright colophon legal bottom imprint",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular archive archives complementary more",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted teaser dfp",
    "talk": "comment comments commentlist reply replies respond discussion discuss disqus feedback reviews guestbook",
    "notice": "cookie cookies consent gdpr notice notices popup modal alert overlay newsletter subscribe subscription signup privacy toast message paywall",
    "tool": "share sharing social follow search login form tags tag meta byline author toolbar button buttons print rating",
}
SIGN_OF = {t: k for k, ts in enumerate(SIGNS.values()) for t in ts.split()}
GROUPS = {
    "p": "p", "h1": "title", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "ul": "list", "ol": "list", "dl": "list", "menu": "menu", "li": "item", "dt": "item", "dd": "item", "main": "main", "article": "main",
    "nav": "menu", "header": "top", "footer": "end", "aside": "side", "form": "form", "fieldset": "form", "dialog": "form", "legend": "form",
    "table": "table", "tr": "table", "td": "table", "th": "table", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote",
    "body": "root", "html": "root", "text": "text",
}
GROUP_NAMES = sorted(set(GROUPS.values()) | {"box"})
GROUP_OF = {t: GROUP_NAMES.index(g) for t, g in GROUPS.items()}
BOX = GROUP_NAMES.index("box")
#: Tag groups and signs that, on an ancestor, mark everything below.
OFF_GROUPS = frozenset(GROUP_NAMES.index(g) for g in ("menu", "top", "end", "side", "form"))
MAIN_GROUP, TOP_GROUP = GROUP_NAMES.index("main"), GROUP_NAMES.index("top")
WIDTH = 22 + len(SIGNS) + len(GROUP_NAMES)


#: Longest attribute values whose signs are remembered.
REMEMBERED = 256


def signs_of(attributes: str) -> int:
    """Bits of the signs among an element's attribute tokens."""
    values = " ".join(ATTRIBUTE.findall(attributes))
    return signs_among(values) if len(values) <= REMEMBERED else signs_among.__wrapped__(values)


@lru_cache(maxsize=65536)
def signs_among(values: str) -> int:
    bits = 0
    for part in PART.findall(values):
        k = SIGN_OF.get(part.lower())
        if k is not None:
            bits |= 1 << k
    return bits


@lru_cache(maxsize=len(RAW))
def raw_tail(tag: str) -> re.Pattern:
    """The end tag of a raw element: its name and white space, a slash or the bracket behind it."""
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|$)", re.I)


def raw_end(source: str, tag: str, at: int) -> int:
    """Where a raw element that opens before ``at`` ends; without an end tag at the end of the page, as HTML has it."""
    end = raw_tail(tag).search(source, at)
    return end.end() if end else len(source)


def mute_ends(source: str, tag: str, at: int, ends: dict[int, int | None]) -> None:
    """Where the mute element that opens before ``at`` ends, and those of its kind inside it; None without an end tag.

    It has none if first the block around it ends, a block opens where none can be, or
    another of its kind opens that cannot be inside it.
    """
    open_, depth = [at], 0
    while open_ and (m := TOKEN.search(source, at)):
        at = m.end()
        shut, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = (name or "").lower()
        if name == tag and shut:
            ends[open_.pop()] = at
        elif name == tag and not attributes.rstrip().endswith("/"):
            if tag in ("button", "select"):
                break
            open_.append(at)
        elif name in RAW and not shut and not (tag == "svg" and attributes.rstrip().endswith("/")):
            at = raw_end(source, name, at)  # a slash ends it in drawings alone
        elif name in BLOCK and name != "hr":
            if not shut and tag in ("svg", "select"):
                break
            if name not in UNENDED:
                depth += -1 if shut else 1
            if depth < 0:
                break
    ends.update(dict.fromkeys(open_))


class Page:
    """Block elements and stray texts in page order: tag group, parent, signs, own text."""

    def __init__(self, source: str):
        self.group, self.parent, self.signs, self.texts, self.links = [BOX], [-1], [0], [[]], [0]
        self.marks: set[int] = set()  # nodes of made pages that hold main text
        self.blocks: list[tuple[int, str]] = []  # node, text
        stack: list[tuple[str, int]] = [("", 0)]  # open elements and their nodes
        where: dict[str, list[int]] = {}  # their places by name, so that no tag walks the stack
        block_at: list[int] = []  # those of blocks
        pieces: list[str] = []
        anchor, linked = 0, 0
        ends: dict[int, int | None] = {}  # of mute elements, by where their start tags end

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    node = stack[-1][1]
                    self.blocks.append((node, text))
                    self.texts[node].append(len(self.blocks) - 1)
                    self.links[node] += min(linked, len(text))
                pieces.clear()
            linked = 0

        def close(depth: int) -> None:
            nonlocal anchor
            if any(t in BLOCK for t, _ in stack[depth:]):
                flush()
            for t, _ in stack[depth:]:
                where[t].pop()
            anchor = len(where.get("a", ()))
            while block_at and block_at[-1] >= depth:
                block_at.pop()
            del stack[depth:]

        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                pieces.append(html.unescape(text) if "&" in text else text)
                if anchor:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            shut, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if shut:
                open_at = where.get(tag)
                # an inline end tag does not leave its block
                if open_at and (tag in BLOCK or not block_at or block_at[-1] < open_at[-1]):
                    close(open_at[-1])
                continue
            if tag == "head":
                continue
            if tag in RAW:
                at = raw_end(source, tag, at)
                pieces.append(" ")
                continue
            if tag in MUTE:
                if attributes.rstrip().endswith("/"):
                    continue
                if at not in ends:
                    mute_ends(source, tag, at, ends)
                if ends[at] is not None:
                    at = ends[at]
                    pieces.append(" ")
                    continue
            if tag in BLOCK:
                if tag in CLOSES:
                    scope = max((where[x][-1] for x in SCOPE if where.get(x)), default=0)
                    found = (where.get(x, ()) for x in ("p", *CLOSES[tag]))
                    ended = [x[k] for x in found if (k := bisect_right(x, scope)) < len(x)]
                    if ended:
                        close(min(ended))
                elif block_at and stack[block_at[-1]][0] == "p":
                    close(block_at[-1])
                flush()
                if tag == "hr":
                    continue
                if tag in ("html", "body") and where.get(tag):
                    continue
                self.group.append(GROUP_OF.get(tag, BOX))
                self.parent.append(stack[-1][1])
                self.signs.append(signs_of(attributes))
                self.texts.append([])
                self.links.append(0)
                if MAIN_MARK in attributes:
                    self.marks.add(len(self.group) - 1)
                where.setdefault(tag, []).append(len(stack))
                block_at.append(len(stack))
                stack.append((tag, len(self.group) - 1))
            elif tag in VOID:
                pieces.append(" ")
            else:
                where.setdefault(tag, []).append(len(stack))
                stack.append((tag, stack[-1][1]))
                anchor += tag == "a"
        flush()
        self._stray()

    def _stray(self) -> None:
        """Texts directly in a node that also has block children become nodes of their own."""
        mixed = set(self.parent)
        for i, (node, text) in enumerate(self.blocks):
            if node in mixed:
                self.group.append(GROUP_OF["text"])
                self.parent.append(node)
                self.signs.append(0)
                self.texts.append([i])
                self.links.append(min(self.links[node], len(text)))
                self.blocks[i] = (len(self.group) - 1, text)
        for node in mixed:
            if node >= 0:
                self.texts[node], self.links[node] = [], 0

    def features(self) -> np.ndarray:
        n = len(self.group)
        parent, group = np.array(self.parent), np.array(self.group)
        chars, words, marks, blocks, end = ([0] * n for _ in range(5))
        start = [float("inf")] * n
        where = 0
        for node, text in self.blocks:
            k = len(text)
            chars[node] += k
            words[node] += text.count(" ") + 1
            marks[node] += text.count(".") + text.count(",")
            blocks[node] += 1
            if where < start[node]:
                start[node] = where
            where += k
            end[node] = where
        links, nodes, top = list(self.links), [1] * n, self.parent
        kids, depth, upper, inside, nested, index, same = ([0] * n for _ in range(7))
        seen: dict[tuple[int, int], int] = {}
        # block elements come before their children and stray texts last, so one pass
        # backwards sums subtrees and one forwards hands down what ancestors say
        for v in range(n - 1, 0, -1):
            p = top[v]
            chars[p] += chars[v]
            words[p] += words[v]
            marks[p] += marks[v]
            blocks[p] += blocks[v]
            links[p] += links[v]
            nodes[p] += nodes[v]
            kids[p] += 1
            if start[v] < start[p]:
                start[p] = start[v]
            if end[v] > end[p]:
                end[p] = end[v]
        for v in range(1, n):
            p = top[v]
            depth[v] = depth[p] + 1
            inside[v] = int(inside[p] or self.group[p] == MAIN_GROUP)
            off = self.group[p] in OFF_GROUPS and not (self.group[p] == TOP_GROUP and inside[p])
            nested[v] = nested[p] | (self.signs[p] & ~1) | (1 << 12 if off else 0)
            index[v] = upper[p]
            upper[p] += 1
            key = (p, self.group[v])
            seen[key] = seen.get(key, 0) + 1
        for v in range(1, n):
            same[v] = seen[top[v], self.group[v]]
        around = np.maximum(parent, 0)
        total = max(where, 1)
        start = [0 if x > where else x for x in start]
        depth, chars, words, marks, blocks, start, end, links, nodes, kids, index, same, inside, nested, signs = map(
            np.array, (depth, chars, words, marks, blocks, start, end, links, nodes, kids, index, same, inside, nested, self.signs)
        )
        cols = [
            depth, np.log1p(chars), links / np.maximum(chars, 1), np.log1p(chars / nodes), np.log1p(kids), chars / total,
            marks / np.maximum(words, 1), np.log1p(words / np.maximum(blocks, 1)), start / total, end / total,
            index / np.maximum(kids[around], 1), np.log1p(kids[around]), same / np.maximum(kids[around], 1),
            chars / np.maximum(chars[around], 1), np.log1p(blocks), inside, (nested >> 12) & 1, (nested & 0xFFF) > 0,
            (nested >> 6) & 1, signs > 0, group[around] == MAIN_GROUP, np.full(n, np.log1p(total)),
        ]
        cols += [(signs >> k) & 1 for k in range(len(SIGNS))]
        cols += [group == k for k in range(len(GROUP_NAMES))]
        return np.stack([np.asarray(c, dtype=np.float32) for c in cols], 1)

    def decode(self, log_odds: np.ndarray) -> list[bool]:
        """The best choice of nodes to keep in which every kept node's parent is kept."""
        gain, parent = log_odds.tolist(), self.parent
        n = len(gain)
        for v in range(n - 1, 0, -1):
            if gain[v] > 0:
                gain[parent[v]] += gain[v]
        keep = [True] * n
        for v in range(1, n):
            keep[v] = keep[parent[v]] and gain[v] > 0
        return keep

    def text(self, keep: list[bool]) -> str:
        return "\n\n".join(t for node, t in self.blocks if keep[node])


# --- pages to learn from -------------------------------------------------------



def page_maker(rng: random.Random) -> str:
    """A page of random layout; elements that hold main text alone carry MAIN_MARK."""
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(a, b))).capitalize() + "."

    def prose(a: int = 1, b: int = 5) -> str:
        return " ".join(words(4, 18) for _ in range(rng.randint(a, b)))

    def links(n: int, wrap: str = "li") -> str:
        made = (f'<{wrap}><a href="/{word()}">{word()} {word() if rng.random() < 0.4 else ""}</a></{wrap}>' for _ in range(n))
        return "".join(made)

    def mark(group: str) -> str:
        name = rng.choice(SIGNS[group].split())
        name = rng.choice([name, f"{word()}-{name}", f"{name}-{word()}", f"{name}_box"])
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"'])

    def box(tag: str, group: str, inner: str) -> str:
        if rng.random() < 0.35:
            inner = f"<div>{inner}</div>"
        kind = rng.choice([tag, "div", "div", "section"])
        plain = kind == tag and tag != "div" and rng.random() < 0.6
        return f"<{kind}{'' if plain else mark(group)}>{inner}</{kind}>"

    def para(tag: str = "p") -> str:
        return f"<{tag}>{prose()}</{tag}>"

    menu = lambda: box("nav", "menu", f"<ul>{links(rng.randint(3, 9))}</ul>" if rng.random() < 0.7 else links(rng.randint(3, 9), "span"))
    side = lambda: box("aside", "side", f"<h3>{word()}</h3><ul>{links(rng.randint(3, 8))}</ul>" if rng.random() < 0.5 else para() + para())
    advert = lambda: f"<div{mark('advert')}>{rng.choice([words(3, 12), para(), links(1, 'p')])}</div>"
    notice = lambda: f"<div{mark('notice')}>{rng.choice([words(5, 20), para()])}{rng.choice(['', '<button>ok</button>', links(1, 'span')])}</div>"
    form = lambda: f"<form{rng.choice(['', mark('tool'), mark('notice')])}><label>{word()}</label><input><p>{words(2, 6)}</p></form>"
    share = lambda: f"<div{mark('tool')}>{rng.choice([links(4, 'span'), f'<ul>{links(3)}</ul>', words(2, 5)])}</div>"

    def talk() -> str:
        def one() -> str:
            tag = rng.choice(["div", "li", "article"])
            name = rng.choice(["", f"<p>{word()} {word()}</p>", f"<span>{word()}</span>"])
            return f"<{tag}{rng.choice(['', mark('talk')])}>{name}{para()}{rng.choice(['', para()])}</{tag}>"

        return box("div", "talk", f"<h3>{word()}</h3>" + "".join(one() for _ in range(rng.randint(1, 6))))

    end = lambda: box("footer", "end", rng.choice([words(3, 15), f"<p>{words(3, 12)}</p>", f"<ul>{links(4)}</ul><p>{words(3, 9)}</p>"]))
    head = lambda: box("header", "top", rng.choice([f"<p>{word()} {word()}</p>", f"<h2>{word()}</h2>{menu()}", words(2, 7)]))

    def main() -> str:
        parts = [f"<h1 {MAIN_MARK}>{words(2, 14)}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.2:
            parts = [f"<header>{''.join(parts)}<p {MAIN_MARK}>{words(4, 10)}</p></header>"]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 24])):
            r = rng.random()
            if r < 0.72:
                parts.append(f"<p {MAIN_MARK}>{prose(1, rng.choice([1, 3, 6, 20]))}</p>")
            elif r < 0.78:
                level = rng.randint(2, 4)
                parts.append(f"<h{level} {MAIN_MARK}>{words(2, 6)}</h{level}>")
            elif r < 0.83:
                parts.append("<ul>" + "".join(f"<li {MAIN_MARK}>{words(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.87:
                parts.append(f"<blockquote><p {MAIN_MARK}>{prose(1, 2)}</p></blockquote>")
            elif r < 0.89:
                parts.append("<table>" + "".join(f"<tr><td {MAIN_MARK}>{word()}</td><td {MAIN_MARK}>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.92:
                parts.append(f"<p {MAIN_MARK}><b>{words(3, 9)}<br>")
            elif r < 0.95:
                parts.append(f"<div {MAIN_MARK}>{prose(1, 3)}</div>")
            else:
                parts.append(rng.choice([advert, share, form, notice, side])())
        if rng.random() < 0.12:
            parts.append(talk())
        kind = rng.choice(["article", "article", "main", "div", "section"])
        named = kind in ("article", "main") and rng.random() < 0.7 or rng.random() < 0.25
        inner = f"<{kind}{'' if named else mark('main')}>{''.join(parts)}</{kind}>"
        return f"<div{rng.choice(['', mark('main')])}>{inner}</div>" if rng.random() < 0.3 else inner

    before = [f() for f in (head, menu, notice, advert, form) if rng.random() < 0.45]
    after = [f() for f in (side, share, talk, advert, end, notice) if rng.random() < 0.45]
    middle = main()
    rng.shuffle(before)
    if rng.random() < 0.25:
        middle = f"<div class='{rng.choice(['wrapper', 'container', 'row', 'layout'])}'>{side()}{middle}{rng.choice(['', side()])}</div>"
    if rng.random() < 0.5:
        after.append(end())
    inner = f"{''.join(before)}{middle}{''.join(after)}"
    body = rng.choice([f"<body>{inner}</body>", f"<body{mark('main')}>{inner}", inner])
    return rng.choice([f"<html><head><title>{words(2, 6)}</title></head>{body}</html>", f"<!DOCTYPE html><html>{body}", body])


def labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a made page: 1 where the subtree holds main text and no ancestor is dropped."""
    page = Page(source)
    main = [v in page.marks for v in range(len(page.group))]
    for v in range(len(main) - 1, 0, -1):
        if main[v]:
            main[page.parent[v]] = True
    return page.features(), np.array(main, dtype=float)


@lru_cache(maxsize=2)
def learn(pages: int = 600, seed: int = 11) -> Boosted:
    """The trees, from ``pages`` made pages; the same in every run."""
    rng = random.Random(seed)
    made = [labelled(page_maker(rng)) for _ in range(pages)]
    return train(np.concatenate([m[0] for m in made]).astype(float), np.concatenate([m[1] for m in made]))


def extract_many(sources: list[str | None], model: Boosted) -> list[str]:
    """The main texts of pages, scored together."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    table = [p.features() for p in pages]
    odds = model.log_odds(np.concatenate(table))
    cuts = np.cumsum([0, *map(len, table)])
    return [p.text(p.decode(odds[a:b])) for p, a, b in zip(pages, cuts, cuts[1:])]


def main_text(pages: DataFrame, html_col: str = "html", into: str = "text", at_once: int = 128) -> DataFrame:
    """All rows and columns and the main text of each whole page.

    Blocks of text in page order, joined by two newlines; inside a block character
    references are decoded and white space is one space. Scripts, styles, frames, form
    fields, buttons, drawings and templates have no text; without an end tag only the
    raw elements of HTML hide what follows. Null, empty and text-less
    pages have an empty text; so do pages whose texts all look like boilerplate. Broken
    markup is read as far as it goes. A column named as ``into`` is replaced; other
    extra columns pass through.
    """
    model = learn()

    @F.pandas_udf("string")
    def text(source: pd.Series) -> pd.Series:
        out: list[str] = []
        for a in range(0, len(source), at_once):
            out.extend(extract_many(source.iloc[a : a + at_once].tolist(), model))
        return pd.Series(out)

    return pages.withColumn(into, text(F.col(html_col)))
