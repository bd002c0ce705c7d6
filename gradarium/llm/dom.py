"""A page as a tree of block elements with features, and pieces of text that belong to them."""

from __future__ import annotations

import html as html_lib
import re

import numpy as np

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.DOTALL,
)
OPENERS = ("<!--", "<![CDATA[")
ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)

#: Elements that are neither nodes nor ends of a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never part of a page's text.
RAW = frozenset("script style noscript template title textarea iframe object svg select head".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
P_SCOPE = frozenset(["table", "td", "th", "button", "div", "section", "article"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TAG_GROUPS = [{"article"}, {"main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "button", "input", "legend"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"p"}, {"li"}, {"ul", "ol", "dl"}, {"section"}, {"div", "center"}, {"blockquote", "pre"}, {"table", "tr", "td", "th", "tbody"}, {"figure", "figcaption"}, {"body", "html"}]
TOKEN_GROUPS = [
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion promoted adsense dfp outbrain taboola",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs skip",
    "header masthead topbar top branding logo tagline",
    "footer foot bottom copyright legal colophon",
    "sidebar side aside widget widgets related recommended recommendations popular trending rail",
    "comment comments reply replies respond disqus discussion responses feedback",
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup subscription paywall disclaimer",
    "share social sharing follow facebook twitter tags meta byline",
    "content article post entry story body text main hentry articlebody prose",
    "form login search signin contact register contentinfo complementary",
]
_TAG_BIT = {t: 1 << k for k, g in enumerate(TAG_GROUPS) for t in g}
_TOKEN_BIT = {t: 1 << (len(TAG_GROUPS) + k) for k, g in enumerate(TOKEN_GROUPS) for t in g.split()}
BITS = len(TAG_GROUPS) + len(TOKEN_GROUPS)
SENTENCE_END = re.compile(r"[.!?…。](?:\s|\Z)")


def mask_of(tag: str, attributes: str, cache: dict) -> int:
    key = (tag, attributes)
    mask = cache.get(key)
    if mask is None:
        mask = _TAG_BIT.get(tag, 0)
        for m in ATTRIBUTE.finditer(attributes):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "")
            for token in re.split(r"[^a-z]+", value.lower()):
                mask |= _TOKEN_BIT.get(token, 0)
        if len(cache) > 20_000:
            cache.clear()
        cache[key] = mask
    return mask


class Page:
    """nodes: lists over block elements in page order, node 0 is the page itself; pieces: (node, text, opens a block)."""

    def __init__(self, html: str, cache: dict | None = None):
        cache = {} if cache is None else cache
        self.tag, self.parent, self.depth, self.mask, self.above = ["html"], [-1], [0], [0], [0]
        self.own, self.text, self.link, self.ends, self.size, self.children, self.order = [0], [0], [0], [0], [1], [0], [0]
        self.attributes = [""]
        self.pieces: list[tuple[int, str, bool]] = []
        stack, names, at, fresh, links = [0], ["html"], 0, True, 0
        search, n, last = TAG.search, len(html), html.rfind(">")
        open_at: dict[str, list[int]] = {}  # where each name stands in the stack

        def close(to: int) -> None:
            while len(stack) > to:
                k = stack.pop()
                open_at[names.pop()].pop()
                p = self.parent[k]
                self.text[p] += self.text[k]
                self.link[p] += self.link[k]
                self.ends[p] += self.ends[k]
                self.size[p] += self.size[k]

        def top(name: str) -> int:
            return open_at[name][-1] if open_at.get(name) else 0

        def find(name: str, stop: frozenset | set) -> int:
            """Where the innermost open element of this name stands, 0 if there is none inside the innermost of `stop`."""
            k = top(name)
            return k if k and k >= max(map(top, stop), default=0) else 0

        while at < n:
            m = search(html, at, last + 1) if at <= last else None  # no tag ends behind the last ">"
            until = m.start() if m else min((k for k in (html.find(x, at) for x in OPENERS) if k >= 0), default=n)
            raw = html[at:until]  # behind it only an unclosed comment is no text, and has the rest of the page
            if raw and not raw.isspace():
                k, size = stack[-1], len(raw)
                self.pieces.append((k, raw, fresh))
                fresh = False
                self.own[k] += size
                self.text[k] += size
                self.ends[k] += len(SENTENCE_END.findall(raw))
                if links:
                    self.link[k] += size
            elif raw and self.pieces and not fresh:
                self.pieces.append((stack[-1], " ", False))
            if not m:
                break
            at = m.end()
            if at == last + 1 and m[0].startswith(OPENERS) and not (m[0].endswith("-->", 4) if m[0][2] == "-" else m[0].endswith("]]>")):
                break  # an unclosed comment
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in INLINE:
                    continue
                k = find(tag, set())
                fresh = True
                if k:
                    close(k)
                    links = 0
                continue
            if tag in INLINE:
                links += tag == "a"
                continue
            if tag == "head" or tag in RAW:
                if tag == "head":
                    continue
                if tag != "svg" or not attributes.endswith("/"):  # of these only svg can close itself
                    end = RAW_END[tag].search(html, at)
                    at = end.end() if end else n
                fresh = True
                continue
            fresh = True
            if tag in VOID:
                continue
            if tag in ("html", "body"):
                self.mask[0] |= mask_of("body", attributes, cache)
                continue
            p_open = find("p", P_SCOPE)
            if p_open:
                close(p_open)
            for other in SIBLINGS.get(tag, ()):
                k = find(other, SCOPE[tag])
                if k:
                    close(k)
            parent = stack[-1]
            k = len(self.tag)
            self.tag.append(tag)
            self.parent.append(parent)
            self.depth.append(len(stack))
            self.mask.append(mask_of(tag, attributes, cache))
            self.above.append(self.above[parent] | self.mask[parent])
            self.attributes.append(attributes)
            self.order.append(self.children[parent])
            self.children[parent] += 1
            for column in (self.own, self.text, self.link, self.ends, self.children):
                column.append(0)
            self.size.append(1)
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(k)
            names.append(tag)
        close(1)

    def features(self) -> np.ndarray:
        """Rows of node features: tags and attribute tokens of the node and above it, subtree density, depth, place
        among and size against the siblings, share of the page."""
        parent = np.array(self.parent)
        parent[0] = 0
        f = lambda x: np.array(x, np.float64)
        text, link, own, size, ends = f(self.text), f(self.link), f(self.own), f(self.size), f(self.ends)
        children, order, depth = f(self.children), f(self.order), f(self.depth)
        start = np.zeros(len(parent))
        node = np.array([p[0] for p in self.pieces], np.int64)
        if len(node):
            before = np.cumsum([0, *[len(p[1]) for p in self.pieces]])
            first = np.unique(node, return_index=True)
            start[first[0]] = before[first[1]] / max(before[-1], 1)
        for k in range(len(parent) - 1, 0, -1):  # a node without own text starts where its first child does
            p = parent[k]
            if start[p] == 0 or start[k] < start[p]:
                start[p] = start[k]
        whole = max(text[0], 1.0)
        others = np.maximum(children[parent] - 1, 1)
        around = (text[parent] - text - own[parent]) / others
        bits = np.array(self.mask, np.int64)[:, None] >> np.arange(BITS) & 1
        above = np.array(self.above, np.int64)[:, None] >> np.arange(BITS) & 1
        columns = [np.log1p(text), np.log1p(own), text / size, link / np.maximum(text, 1), ends / size, ends / np.maximum(text, 1) * 100, depth, order, children, children[parent], order / np.maximum(children[parent] - 1, 1), np.log1p(np.maximum(around, 0)), text / whole, text / np.maximum(text[parent], 1), start, np.full(len(parent), np.log(whole)), link[parent] / np.maximum(text[parent], 1)]
        return np.concatenate([np.stack(columns, 1), bits, above], 1)


def decode(parent: list[int], own: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The likeliest keep or drop of every node such that nothing is kept under a dropped node: a best choice for
    every subtree from the leaves up, then from the page down. The page itself is kept."""
    weight = 1 + own / 40
    keep = -np.logaddexp(0, -margin) * weight
    drop = -np.logaddexp(0, margin) * weight
    best_keep, best_drop = keep.copy(), drop.copy()
    for k in range(len(parent) - 1, 0, -1):
        p = parent[k]
        best_drop[p] += best_drop[k]
        best_keep[p] += max(best_keep[k], best_drop[k])
    kept = np.zeros(len(parent), bool)
    kept[0] = True
    for k in range(1, len(parent)):
        kept[k] = kept[parent[k]] and best_keep[k] > best_drop[k]
    return kept


def page_text(page: Page, kept: np.ndarray) -> str:
    parts, open_block = [], True
    for node, raw, fresh in page.pieces:
        open_block = open_block or fresh
        if kept[node]:
            if open_block:
                parts.append(" ")
                open_block = False
            parts.append(html_lib.unescape(raw) if "&" in raw else raw)
        else:
            open_block = True
    return " ".join("".join(parts).split())
