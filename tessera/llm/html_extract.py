"""Main text of web pages by a tree-structured graphical model of the DOM (operator 1).

Model: every block element, every inline element with a class, id or role, and every run of text is a
node with a hidden label, content or not.
Parent-child potentials connect a node to its element, unary potentials hold what is seen at the
node: tag, words of class, id and role, share of linked text, copyright sign. Both are estimated from labelled pages. Sum-product message passing, once upward and once downward, gives
each run's exact marginal; runs at 0.5 or more are the main text.

What says nothing must not count against a text: an element's class speaks by its words alone, unknown words say
nothing, and general boxes speak only where most of their text is linked, once for a list and not for each of its items. The
words of an inline element, and what speaks against a box, are part of its edge, normalised for either label of its parent: they
decide about the element and never about what it stands in. Inline elements of wording (em, code and the like) have no words, links none within a sentence.

The labelled pages are (html, list of content blocks). ``labelled_pages`` writes them from a seed: a
bounded set in many layouts, whose texts say little about the label, with class words drawn apart from it, so that structure decides.

Plan: one scan, no shuffle; a page is parsed by one pass of a tokeniser that never recurses, and a
task holds one batch. The fitted potentials are a few hundred numbers.

Defined results: a null or empty page has the empty text. Character references are decoded once; white
space inside a block becomes one space; blocks are trimmed and joined by two line feeds; nothing is
cut. Unclosed, misnested and truncated markup is read as a browser would in outline; an unclosed
button, drawing or other silent element hides no more than the text up to the next tag. Text of
hidden elements (hidden, aria-hidden, by style) is left out. Repeated rows give repeated results; other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import tidy

PAGES = 1500
SEED = 7

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose contents are characters and not markup, shown only in the second list.
_RAW = frozenset("script style textarea title iframe noframes".split())
_PLAIN = frozenset(("xmp",))
#: Elements whose text is never shown as part of a page's prose, but for unclosed ones.
_SILENT = frozenset("noscript template object svg select option optgroup button canvas audio video".split())
_SILENT_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_SILENT))})\b[^>]*>", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes open elements of the value, up to the nearest one outside it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
#: Elements of wording: their classes are about looks.
_WORDING = frozenset("abbr b bdi bdo big cite code data del dfn em font i kbd mark q s samp small strike strong sub sup time tt u var".split())
#: Boxes that hold anything, and lists: they speak only by the share of linked text.
_GENERAL = frozenset("div section center ul ol menu dl table hgroup details dialog fieldset figure".split())
_SCOPE = frozenset("ul ol menu dl table body html article div section main".split())


class Page:
    """Nodes in page order. A node is an element or a run of text; its parent comes before it."""

    def __init__(self, html: str | None):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.words: list[tuple[str, ...]] = [()]
        self.text: list[str] = [""]
        self.linked: list[int] = [0]
        #: The block that a run is part of: runs of one block are one piece of text.
        self.block_of: list[int] = [-1]
        self.block = 0
        self._read(html or "")

    def _add(self, parent: int, tag: str, words: tuple[str, ...], text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        self.block_of.append(self.block)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        stack = [(0, "#root", False)]  # node, name, whether its text is hidden
        run: list[str] = []
        linked = anchors = 0
        in_head = False
        closed_at: dict[int, int] | None = None

        def flush() -> None:
            nonlocal linked
            if run:
                joined = "".join(run)
                if size := len(" ".join(joined.split())):
                    self._add(stack[-1][0], "#text", (), joined, min(linked, size))
                elif self.block_of[-1] == self.block and self.tag[-1] == "#text":
                    self.text[-1] += " "
                run.clear()
            linked = 0

        def end_block() -> None:
            flush()
            self.block += 1

        at = 0
        while True:
            m = _TOKEN.search(html, at)
            piece = html[at : m.start()] if m else html[at:]
            if piece and not in_head and not stack[-1][2]:
                if "&" in piece:
                    piece = unescape(piece)
                run.append(piece)
                if anchors:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA[") and not in_head and not stack[-1][2]:
                    run.append(m[0][9:].removesuffix("]]>"))
                continue
            name, closing, rest = name.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
            if not closing and (name in _RAW or name in _PLAIN):
                if not rest.endswith("/"):
                    end = _end_of(name).search(html, at)
                    if name in _PLAIN and not in_head and not stack[-1][2]:
                        run.append(html[at : end.start() if end else len(html)])
                    at = end.end() if end else len(html)
                continue
            if name == "head":
                in_head = not closing
            elif name == "body":
                in_head = False
            if name == "a":
                anchors = 0 if closing else 1
            if name == "br":
                run.append(" ")
            elif name in _SILENT:
                if not closing and not rest.endswith("/"):
                    if closed_at is None:
                        closed_at = _closed(html)
                    following = closed_at.get(m.start()) or html.find("<", at)
                    at = following if following >= 0 else len(html)
            elif name not in _BLOCKS:
                if closing:
                    self._close(stack, name, flush)
                elif rest and not rest.endswith("/") and name not in _VOID and (words := _attribute_words(rest)):
                    flush()
                    stack.append((self._add(stack[-1][0], name, words), name, stack[-1][2] or "#hidden" in words))
            elif closing:
                end_block()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][1] == name:
                        del stack[depth:]
                        break
                anchors = 0
            else:
                end_block()
                anchors = 0
                in_head = False
                for closed in ("p", *_CLOSES.get(name, ())):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][1] == closed:
                            del stack[depth:]
                            break
                        if stack[depth][1] in _SCOPE or (closed == "p" and stack[depth][1] in _BLOCKS):
                            break
                words = _attribute_words(rest) if rest else ()
                node = self._add(stack[-1][0], name, words)
                if name not in _VOID:
                    stack.append((node, name, stack[-1][2] or "#hidden" in words))
        flush()

    @staticmethod
    def _close(stack: list[tuple[int, str, bool]], name: str, flush) -> None:
        """Ends an inline element, unless a block has begun within it."""
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][1] == name:
                flush()
                del stack[depth:]
                return
            if stack[depth][1] in _BLOCKS:
                return


def _closed(html: str) -> dict[int, int]:
    """Where silent elements that end begin, and where they end."""
    open_: dict[str, list[int]] = {}
    found = {}
    for m in _SILENT_TAG.finditer(html):
        name = m[2].lower()
        if not m[1]:
            open_.setdefault(name, []).append(m.start())
        elif open_.get(name):
            found[open_[name].pop()] = m.end()
    return found


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>", re.I)


@lru_cache(maxsize=20_000)
def _attribute_words(rest: str) -> tuple[str, ...]:
    found = set()
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-testid"):
            found.update(w.lower() for w in _WORD.findall(value))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            found.add("#hidden")
    return tuple(sorted(found))


def observations(page: Page) -> list[tuple]:
    """What is seen at each node, as a tuple of features."""
    n = len(page.parent)
    size, linked = [len(" ".join(t.split())) for t in page.text], list(page.linked)
    whole: dict[int, list[int]] = {}  # of each block: characters, linked ones
    for block, tag, a, b in zip(page.block_of, page.tag, size, linked):
        if tag == "#text":
            sums = whole.setdefault(block, [0, 0])
            sums[0] += a
            sums[1] += b
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
    share = lambda a, b: 0 if not a else 1 if 3 * a < b else 2 if 10 * a < 9 * b else 3
    seen: list[tuple] = []
    told: set[int] = set()
    for i in range(n):
        tag, words = page.tag[i], page.words[i]
        if tag == "#text":
            above = page.parent[i]
            while above > 0 and page.tag[above] not in _BLOCKS:
                above = page.parent[above]
            # the links of an item or paragraph are told by its element or list, those of loose text by its first run
            loose = _edge(page.tag[above]) == "box" and page.block_of[i] not in told
            told.add(page.block_of[i])
            b, a = whole[page.block_of[i]]
            seen.append(((("linked", share(a, b)),) if loose else ()) + (("sign", "©" in page.text[i]),))
        elif tag not in _BLOCKS and i:
            b, a = whole.get(_block_below(page, i), (0, 0))
            silent = tag in _WORDING or (tag == "a" and share(a, b) < 3)
            seen.append(() if silent else tuple(("word", w) for w in words))
        else:
            outer = tag in _GENERAL and page.tag[page.parent[i]] in ("body", "html", "#root")
            told_by_links = share(linked[i], size[i]) if tag in _GENERAL or _edge(tag) == "inner" else 0
            seen.append((("tag", (tag, told_by_links, outer)), *(("word", w) for w in words)))
    return seen


def _block_below(page: Page, i: int) -> int:
    """The block that the first run inside an inline element is part of."""
    last = {i}
    for j in range(i + 1, len(page.parent)):
        if page.parent[j] not in last:
            break
        if page.tag[j] == "#text":
            return page.block_of[j]
        last.add(j)
    return -1


#: Largest log-odds of a feature. Lengths and punctuation are no features: a page of many short blocks would outvote its structure.
_STRENGTH = {"tag": 6.0, "word": 6.0, "linked": 1.0, "sign": 1.0}
#: Paragraphs, items, cells, headings, inline elements and runs come in numbers: their tags may only speak against content, and only clearly.
_INNER_STRENGTH, _GENERAL_STRENGTH, _CLEAR = 1.0, 2.0, 0.75
#: A class word speaks if it was seen so often and clearly; few sightings with one label alone are clear.
_LEAST_SEEN, _CLEAR_WORD, _WORD_SMOOTHING = 8, 1.5, 0.1
#: Items of lists say nothing by their own tags and links, their lists do.
_ITEMS = frozenset("li dt dd tr tbody thead tfoot".split())
#: Least probability that an inner element or run differs from its parent, where that is no content and where it is.
_FLOOR = {"text": (0.001, 0.001), "inner": (0.1, 0.1), "inline": (0.01, 0.3), "box": (0.01, 0.04)}


class Model:
    """Unary log-odds of features and a 2 by 2 table for each kind of parent-child edge."""

    def __init__(self, unary: dict[tuple, float], edges: dict[str, tuple[float, float, float, float]], prior: float):
        self.unary, self.edges, self.prior = unary, edges, prior
        self._known: dict[tuple, float] = {}

    def _odds(self, seen: tuple) -> float:
        found = self._known.get(seen)
        if found is None:
            found = sum(self._word(f[1]) if f[0] == "word" else self.unary.get(f, 0.0) for f in seen)
            if len(self._known) < 50_000:
                self._known[seen] = found
        return found

    def _word(self, word: str) -> float:
        """The log-odds of a class word; of an unknown one those of the longest known word that begins or ends it."""
        known = self.unary.get(("word", word))
        for n in range(len(word) - 1, 3, -1):
            if known is not None:
                return known
            known = self.unary.get(("word", word[:n]), self.unary.get(("word", word[-n:])))
        return known or 0.0

    def potentials(self, page: Page) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Of every node the unary log-odds and the table of its edge: 2 * parent + node."""
        unary, kinds = [self._odds(s) for s in observations(page)], [self.edges[_edge(t)] for t in page.tag]
        unary[0] += self.prior
        for i, tag in enumerate(page.tag):
            kind = _edge(tag) if i else "#root"
            if (kind == "inline" and unary[i]) or (kind in ("box", "inner") and unary[i] < 0):
                p00, p01, p10, p11 = kinds[i]
                odds = math.exp(unary[i])
                a, b = p00 + p01 * odds, p10 + p11 * odds
                kinds[i], unary[i] = (p00 / a, p01 * odds / a, p10 / b, p11 * odds / b), 0.0
        return unary, kinds

    def marginals(self, page: Page) -> list[float]:
        """Log-odds of content at every node, by one upward and one downward sweep."""
        exp, log = math.exp, math.log
        belief, kinds = self.potentials(page)
        n = len(belief)
        up = [0.0] * n
        parent = page.parent
        for i in range(n - 1, 0, -1):
            odds = exp(max(-40.0, min(40.0, belief[i])))
            p00, p01, p10, p11 = kinds[i]
            up[i] = log((p10 + p11 * odds) / (p00 + p01 * odds))
            belief[parent[i]] += up[i]
        for i in range(1, n):
            odds = exp(max(-40.0, min(40.0, belief[parent[i]] - up[i])))
            p00, p01, p10, p11 = kinds[i]
            belief[i] += log((p01 + p11 * odds) / (p00 + p10 * odds))
        return belief

    def blocks(self, html: str | None) -> list[str]:
        page = Page(html)
        kept: dict[int, list[str]] = {}
        for text, tag, block, odds in zip(page.text, page.tag, page.block_of, self.marginals(page)):
            if tag == "#text" and odds >= 0:
                kept.setdefault(block, []).append(text)
        return [" ".join("".join(parts).split()) for parts in kept.values()]


def _edge(tag: str) -> str:
    return "text" if tag == "#text" else "inner" if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "tbody", "pre") else "inline" if tag not in _BLOCKS else "box"


def train(pages: Iterable[tuple[str, list[str]]], smoothing: float = 0.5) -> Model:
    """Potentials from labelled pages: (html, the blocks of its main text in page order)."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    kinds: dict[str, np.ndarray] = {k: np.full((2, 2), smoothing) + (np.eye(2) * 10 if k == "inline" else 0) for k in ("text", "inner", "inline", "box")}
    groups: dict[int, Counter] = {0: Counter(), 1: Counter()}
    labelled: list[tuple[Page, list[int]]] = []
    for html, blocks in pages:
        page, wanted = Page(html), Counter(blocks)
        n = len(page.parent)
        good, all_ = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if page.tag[i] == "#text":
                good[i], all_[i] = int(wanted[" ".join(page.text[i].split())] > 0), 1
            if i:
                good[page.parent[i]] += good[i]
                all_[page.parent[i]] += all_[i]
        # an element of mixed runs is content: what it holds need not be
        label = [1 if g else 0 for g in good]
        labelled.append((page, label))
        for i, seen in enumerate(observations(page)):
            counts[label[i]].update(seen)
            groups[label[i]].update({f[0] for f in seen})
            if i:
                kinds[_edge(page.tag[i])][label[page.parent[i]], label[i]] += 1
    unary = {}
    values = Counter(f[0] for f in {*counts[0], *counts[1]})
    for f in {*counts[0], *counts[1]}:
        if f[0] == "word" and counts[0][f] + counts[1][f] < _LEAST_SEEN:
            continue
        some = _WORD_SMOOTHING if f[0] == "word" else smoothing
        a, b = ((counts[c][f] + some) / (groups[c][f[0]] + some * values[f[0]]) for c in (1, 0))
        most = _STRENGTH[f[0]]
        value = max(-most, min(most, math.log(a / b)))
        if f[0] == "word" and abs(value) < _CLEAR_WORD:
            value = 0.0
        if f[0] in ("linked", "sign") or (f[0] == "tag" and _edge(f[1][0]) == "inner"):
            told = f[1] is True if f[0] == "sign" else (f[1] if f[0] == "linked" else f[1][1]) >= 2
            value = max(-_INNER_STRENGTH, value) if value <= -_CLEAR and told else 0.0
        if f[0] == "tag" and f[1][0] in _GENERAL:
            value = (value if f[1][2] else max(-_GENERAL_STRENGTH, value)) if value <= -_CLEAR and f[1][1] >= 2 else 0.0
        if f[0] == "tag" and (f[1][0] in _ITEMS or f[1][0] == "#root"):
            value = 0.0
        unary[f] = value
    # what speaks for or against a box is in its potential: its edge tells what a box is that nothing speaks of
    told, kinds["box"] = Model(unary, {}, 0.0), np.full((2, 2), smoothing)
    for page, label in labelled:
        for i, seen in enumerate(observations(page)):
            if i and _edge(page.tag[i]) == "box" and abs(told._odds(seen)) < _CLEAR:
                kinds["box"][label[page.parent[i]], label[i]] += 1
    tables = {}
    for kind, t in kinds.items():
        stay = np.clip(np.diag(t) / t.sum(1), 0, 1 - np.array(_FLOOR[kind]))
        tables[kind] = (float(stay[0]), float(1 - stay[0]), float(1 - stay[1]), float(stay[1]))
    return Model(unary, tables, 0.0)


# Class and id words of common page furniture and of main text, for the written training pages.
_FURNITURE = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager links skip toc",
    "header": "header masthead banner branding logo hero-nav tagline",
    "footer": "footer colophon copyright legal imprint footnote-links sitemap",
    "aside": "sidebar aside widget rail related recommended trending popular promo teaser complementary",
    "ad": "ad ads advert advertisement sponsor sponsored adsense banner-ad promo-box commercial dfp outbrain taboola",
    "notice": "notice alert cookie consent gdpr popup modal overlay message warning info-bar disclaimer paywall announcement",
    "form": "form search newsletter subscribe signup login register contact-form poll",
    "comment": "comments comment reply replies discussion disqus responses thread respond comment-list comment-body reader",
    "share": "share social sharing buttons follow tags meta byline author-box rating",
}
_MAIN = "content main article post entry story body text prose page article-body post-content entry-content main-content story-body single markdown rich-text hentry articleBody"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """``n`` written pages in many layouts with the blocks of their main text."""
    rng = random.Random(seed)
    syllables = "an ber cha dor el fen gi ha ion ka lu men no or pa que ri sta tion un ver wa ze ä é ño".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def prose(most: int) -> str:
        words = [word() for _ in range(max(1, int(rng.expovariate(1.2) * most / 3) if rng.random() < 0.85 else rng.randint(1, 3)))]
        end = rng.choice([".", ".", ".", "!", "?", "", " |", "$$$", "%%%"])
        return " ".join(words).capitalize() + end

    places = "top bottom left right inner outer first last wide narrow col row wrap box block item list group panel grid cell lead intro primary secondary link note title more external".split()

    def anyhow() -> str:
        """A class word that says nothing about the label."""
        return rng.choice([word(), f"{word()}-{word()}", rng.choice(places), f"{rng.choice(places)}-{word()}", f"{rng.choice(places)}-{rng.randint(1, 12)}"])

    def plain(p: float = 0.3) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(anyhow() for _ in range(rng.choice([1, 1, 2])))}"' if rng.random() < p else ""

    def classed(words: str, p: float = 0.85) -> str:
        if rng.random() > p:
            return plain()
        chosen = rng.sample(words.split(), 1 + (rng.random() < 0.25)) + ([anyhow()] if rng.random() < 0.3 else [])
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(chosen)}"'

    def links(tag: str = "li") -> str:
        items = [f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 5)))}</a>' for _ in range(rng.randint(1, 9))]
        return "<ul>" + "".join(f"<{tag}>{x}</{tag}>" for x in items) + "</ul>" if rng.random() < 0.8 else " | ".join(items)

    def lines(most: int = 30) -> str:
        k = rng.randint(1, 3)
        return "".join(f"<p>{escape(prose(most))}</p>" if rng.random() < 0.6 else escape(prose(most)) + " " for _ in range(k))

    def furniture(kind: str) -> str:
        box = rng.choice(["div", "div", "section"])
        words = _FURNITURE[kind]
        if kind == "nav":
            tag = rng.choice(["nav", "nav", "div", "ul"])
            inner = links() if tag != "ul" else "".join(f'<li><a href="/">{word()}</a></li>' for _ in range(5))
            return f"<{tag}{classed(words, 0.5 if tag == 'nav' else 0.8)}>{inner}</{tag}>"
        if kind == "header":
            tag = rng.choice(["header", "header", "div"])
            return f"<{tag}{classed(words, 0.5 if tag == 'header' else 1)}>{rng.choice([lines(6), f'<a href=/>{word()}</a>', f'<h2>{word()}</h2>', furniture('nav')])}</{tag}>"
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            return f"<{tag}{classed(words, 0.4 if tag == 'footer' else 1)}>{rng.choice(['&copy; ', '', '&copy; 2024 '])}{word()}.example.com {rng.choice(['&middot;', '|', ''])} {rng.choice([lines(20), links(), escape(prose(20))])}</{tag}>"
        if kind == "aside":
            tag = rng.choice(["aside", "aside", "div", "section"])
            return f"<{tag}{classed(words, 0.5 if tag == 'aside' else 1)}>{rng.choice(['', f'<h3>{word()}</h3>', f'<h4>{word()}</h4>'])}{rng.choice([links(), lines(), lines()])}</{tag}>"
        if kind == "form":
            tag = rng.choice(["form", "form", "div"])
            return f"<{tag}{classed(words, 0.4 if tag == 'form' else 1)}><label>{word()}</label><input name=q>{lines(8)}<button>{word()}</button></{tag}>"
        if kind == "comment":
            one = lambda: rng.choice([f"<div{classed(words, 0.8)}>{lines(40)}</div>", f"<li{classed(words, 0.7)}>{lines(40)}</li>", f'<article class="comment">{lines(40)}</article>', f"<p>{escape(prose(40))}</p>"])
            return f"<{box}{classed(words, 1)}>{rng.choice(['', '<h3>' + word() + '</h3>', '<h2>' + word() + '</h2>'])}{''.join(one() for _ in range(rng.randint(1, 5)))}</{box}>"
        return f"<{box}{classed(words, 1)}>{rng.choice([lines(), escape(prose(30)), lines(12)])}</{box}>"

    pages = []
    for _ in range(n):
        blocks: list[str] = []

        def said(text: str) -> str:
            blocks.append(" ".join(text.split()))
            return escape(text)

        def paragraph() -> str:
            r = rng.random()
            if r < 0.68:
                text = prose(90)
                shown = said(text)
                if rng.random() < 0.3:
                    shown = rng.choice([f"<b>{shown}</b>", f"<b>{shown}<br>", f"<em>{shown}</em>", f"<span>{shown}</span>", f'<a href="/x">{shown}</a>', f'<span class="{word()}">{shown}</span>', f'<{(k := rng.choice(["b", "span", "em"]))} id="{word()}">{shown}</{k}>'])
                if rng.random() < 0.02:
                    shown += f'<span{classed(_FURNITURE[rng.choice(["ad", "ad", "share", "notice"])], 1)}>{escape(prose(10))}</span>'
                return f"<p{plain()}>{shown}" + ("</p>" if rng.random() < 0.85 else "")
            if r < 0.76:
                return f"<h{(k := rng.randint(2, 4))}{plain()}>{said(prose(8))}</h{k}>"
            if r < 0.84:
                linked = rng.random() < 0.15
                item = lambda: f'<a href="/x">{said(prose(15))}</a>' if linked else said(prose(15))
                return f"<ul{plain()}>" + "".join(f"<li{plain(0.1)}>{item()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            if r < 0.88:
                return f"<blockquote>{said(prose(30))}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{said(prose(30))}</p></blockquote>"
            if r < 0.91:
                return f"<pre>{said(prose(20))}</pre>"
            if r < 0.94:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{said(prose(4))}</td>" for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
            if r < 0.96:
                return f"<figure><img src=x><figcaption>{said(prose(12))}</figcaption></figure>"
            return f"<div{plain()}>{said(prose(60))}</div>"

        def body() -> str:
            out = f"<h1>{said(prose(10))}</h1>" if rng.random() < 0.8 else ""
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12])):
                out += paragraph()
                if rng.random() < 0.1:
                    out += furniture(rng.choice(["ad", "aside", "share", "notice", "form"]))
            return out

        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        open_ = f"<{tag}{classed(_MAIN, 0.3 if tag in ('article', 'main') else 0.7)}>"
        inner = body()
        if rng.random() < 0.25:
            inner = f"<div{classed(_MAIN, 0.8)}>{inner}</div>"
        if rng.random() < 0.12:
            inner += furniture("comment")
        main = f"{open_}{inner}</{tag}>"
        if tag == "td":
            main = f"<table><tr>{main}<td{classed(_FURNITURE['aside'], 1)}>{links()}</td></tr></table>"
        if rng.random() < 0.3:
            main = f"<main>{main}</main>" if rng.random() < 0.5 else f'<div class="{rng.choice(["container", "wrapper", "row", "layout", "site", anyhow(), anyhow()])}">{main}{furniture("aside") if rng.random() < 0.5 else ""}</div>'
        before = "".join(furniture(k) for k in rng.choice([["nav"], ["header", "nav"], ["header"], ["nav", "ad"], ["notice", "header", "nav"], ["ad"], []]))
        after = "".join(furniture(k) for k in rng.choice([["footer"], ["aside", "footer"], ["comment", "footer"], ["share", "comment", "footer"], ["form", "footer"], ["ad", "footer"], ["nav", "footer"]]))
        shut = "</body></html>" if rng.random() < 0.9 else ""
        pages.append((f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{before}{main}{after}{shut}", blocks))
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars, the text's code points."""
    model = model or default_model()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = ["\n\n".join(model.blocks(h)) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
