"""Main text of web pages from flat text blocks and a decision tree.

A page is read once, from left to right, into blocks: runs of text between tags that begin or end a block. A block's features are its number of words
and share of linked words, the same of the blocks before and after it, whether an element round it is
by its name or what its class names part of the page's frame or of an article, whether a class only has a frame's word in it, whether it is a heading, or prose by its element
or its last sign, and whether the page has an article at all. A decision tree, trained on the labelled table below, keeps or drops it.

Class words of an element may be those of a layout, not of a frame. So a ``main`` element ends every frame round it that comes from class words only, and an
``article`` does unless that frame has articles of its own (comments, teasers) or the page has a longer article outside such frames. A form is no frame of an
article in it, nor if the page is in it.

Defined cases: NULL or empty html gives empty text; unclosed elements end with what holds them, or with the page; an unclosed script, style or comment hides the rest;
repeated rows are repeated. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
#: Elements whose inside is no text of the page; the first ones hide the rest of the page if nothing ends them.
_UNENDING = {"script", "style"}
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in "script style noscript template svg iframe object textarea title canvas".split()}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCKS = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is prose however short, and what a sentence ends with.
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption".split())
_STOPS = tuple(".!?\u2026:;\u3002\uff01\uff1f") + ('."', ".\u201d")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FRAME_TAGS = set("nav footer aside menu dialog button head label".split())
_MAIN_TAGS = {"article", "main"}
#: Words that name a part of a page's frame; what counts is their place in a name, see ``_words``.
_FRAME_WORDS = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments complementary consent contentinfo cookie cookies "
    "copyright dialog disclaimer disqus "
    "footer foot form gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
#: Words at the end of a name that say how or where something is shown: what a name names is the word before them.
_SHOWN = set(
    "area bar block body bottom box button buttons col column container content desktop fixed form group holder icon icons inner item items left link links list mobile "
    "outer panel primary region right row secondary section slot sticky title top unit widget widgets wrap wrapper zone".split()
)
#: Frame words that are written as two.
_PAIRS = {("side", "bar"): "sidebar", ("nav", "bar"): "navbar", ("tool", "bar"): "toolbar", ("top", "bar"): "topbar", ("sign", "up"): "signup", ("pop", "up"): "popup"}
_ARTICLE_WORDS = set("article entry post story".split())
_MAIN_WORDS = _ARTICLE_WORDS | {"content", "main"}
#: Frames whose articles are comments or teasers.
_OWN_ARTICLES = set(
    "ad ads advert adverts advertisement advertising comment comments disqus promo promotion recommended related replies reply respond "
    "sponsor sponsored widget widgets".split()
)
#: From these words on a name says what its element has or how it is shown, not what it is.
_MODIFIERS = set("has with without no not overflow backface".split())
_WRAPS = {"wrap", "wrapper"}
#: Share of the words outside other frames that a form holds if the whole page is in it.
FORM_SHARE = 0.9

#: Labelled blocks, by hand: words, linked share, the same two of the block before and after, in a frame, in an article, heading, in something with a frame's word
#: inside its name, a paragraph, on a page without an article; then whether the block is main text.
LABELLED = """
6 1.0 0 0.0 5 1.0 1 0 0 1 1 0 0
3 1.0 3 1.0 2 1.0 1 0 0 0 1 1 0
2 1.0 2 1.0 2 1.0 0 0 0 0 1 1 0
1 1.0 1 1.0 60 0.0 1 0 0 0 1 0 0
9 0.0 1 1.0 8 0.0 1 0 0 1 1 0 0
12 0.0 1 1.0 6 0.0 1 0 0 0 0 1 0
40 0.0 2 1.0 70 0.0 1 0 0 1 1 1 0
90 0.0 3 1.0 12 0.0 1 0 0 0 1 0 0
25 0.2 80 0.0 0 0.0 1 0 0 1 0 0 0
8 0.1 120 0.0 0 0.0 1 0 0 0 1 1 0
14 0.0 60 0.0 14 0.0 1 1 0 1 1 1 0
35 0.0 90 0.0 35 0.0 1 1 0 0 0 0 0
120 0.0 40 0.0 40 0.0 1 1 0 1 1 0 0
5 0.8 70 0.0 80 0.0 1 1 0 0 1 1 0
2 0.0 70 0.0 30 0.0 1 1 1 1 0 1 0
3 0.0 5 0.0 9 0.0 1 0 1 0 1 0 0
8 0.0 9 0.0 70 0.0 0 1 1 0 1 0 1
4 0.0 100 0.0 90 0.0 0 1 1 0 0 0 1
2 0.0 0 0.0 3 0.0 0 1 1 1 1 0 1
10 0.3 80 0.0 60 0.0 0 1 1 0 1 0 1
70 0.0 8 0.0 90 0.0 0 1 0 0 0 0 1
90 0.1 70 0.0 2 0.0 0 1 0 0 1 0 1
2 0.0 90 0.0 100 0.0 0 1 0 1 1 0 1
1 0.0 60 0.0 1 0.0 0 1 0 0 0 0 1
1 0.0 1 0.0 9 0.0 0 1 0 0 1 0 1
3 0.0 1 0.0 8 0.0 0 1 0 0 1 0 1
15 0.5 90 0.0 60 0.0 0 1 0 1 0 0 1
6 0.3 40 0.0 40 0.1 0 1 0 0 1 0 1
300 0.0 8 0.0 0 0.0 0 1 0 0 1 0 1
40 0.2 30 0.1 50 0.2 0 1 0 0 0 0 1
5 0.0 90 0.0 0 0.0 0 1 0 1 1 0 1
1 0.0 0 0.0 0 0.0 0 1 0 0 1 0 1
9 0.0 0 0.0 0 0.0 0 1 0 0 0 0 1
20 0.0 0 0.0 0 0.0 0 1 0 0 1 0 1
3 0.0 60 0.0 4 1.0 0 1 0 1 1 0 1
7 0.0 70 0.0 3 1.0 0 1 0 0 0 0 1
12 0.0 2 1.0 2 1.0 0 1 0 0 1 0 1
50 0.0 5 1.0 3 1.0 0 1 0 0 1 0 1
2 0.0 8 0.0 2 1.0 0 1 0 1 0 0 1
4 0.0 3 1.0 0 0.0 0 1 1 0 1 0 1
6 0.0 2 1.0 4 1.0 0 1 1 0 1 0 1
8 0.4 40 0.0 2 0.9 0 1 0 0 0 0 1
4 1.0 90 0.0 4 1.0 0 1 0 1 1 0 0
3 1.0 3 1.0 8 0.0 0 1 0 0 1 0 0
5 1.0 60 0.0 70 0.0 0 1 0 0 0 0 0
12 1.0 12 1.0 12 1.0 0 1 0 0 1 0 0
80 0.0 6 0.0 90 0.0 0 0 0 0 1 1 1
60 0.1 80 0.0 70 0.0 0 0 0 0 0 0 1
150 0.0 2 1.0 3 1.0 0 0 0 0 1 1 1
30 0.0 60 0.0 40 0.0 0 0 0 0 0 0 1
25 0.0 20 0.0 30 0.0 0 0 0 0 1 1 1
18 0.0 90 0.0 45 0.0 0 0 0 0 0 0 1
5 0.0 80 0.0 60 0.0 0 0 0 0 1 0 1
9 0.0 50 0.0 90 0.1 0 0 0 0 1 0 1
7 0.0 3 1.0 80 0.0 0 0 1 0 1 0 1
6 0.0 90 0.0 70 0.0 0 0 1 0 1 0 1
4 0.0 4 1.0 4 1.0 0 0 1 0 0 1 0
3 0.0 3 1.0 5 1.0 0 0 0 0 1 0 0
8 0.0 2 1.0 2 1.0 0 0 0 0 0 1 0
5 0.0 0 0.0 2 1.0 0 0 0 0 1 0 0
6 0.0 90 0.0 0 0.0 0 0 0 0 0 1 0
7 0.1 60 0.0 2 1.0 0 0 0 0 1 0 0
3 0.0 2 1.0 0 0.0 0 0 0 0 0 1 0
10 0.9 60 0.0 5 1.0 0 0 0 0 0 1 0
30 0.8 12 0.9 15 0.7 0 0 0 0 1 1 0
45 0.9 3 1.0 50 0.9 0 0 0 0 0 1 0
20 0.6 6 1.0 8 0.9 0 0 0 0 1 1 0
40 0.0 2 0.0 4 1.0 0 0 0 0 0 0 1
40 0.0 0 0.0 0 0.0 0 0 0 0 1 1 1
90 0.0 0 0.0 0 0.0 0 0 0 0 0 0 1
60 0.0 2 0.0 4 1.0 0 0 0 0 1 1 1
200 0.0 5 1.0 0 0.0 0 0 0 0 0 0 1
22 0.0 8 0.0 35 0.0 0 0 0 0 1 1 1
2 0.0 60 0.0 60 0.0 0 0 0 0 1 0 1
2 0.0 40 0.0 40 0.0 0 0 0 0 1 0 1
2 0.0 0 0.0 5 0.0 0 0 1 0 1 1 1
5 0.0 2 0.0 4 0.0 0 0 0 0 1 1 1
4 0.0 5 0.0 0 0.0 0 0 0 0 1 1 1
6 0.0 3 0.0 7 0.0 0 0 0 0 1 1 1
3 0.0 4 1.0 6 0.0 0 0 1 0 1 1 1
8 0.2 5 0.0 2 1.0 0 0 0 0 1 1 1
1 0.0 0 0.0 3 0.0 0 0 1 0 1 1 1
7 0.0 0 0.0 0 0.0 0 0 0 0 1 1 1
2 0.0 0 0.0 0 0.0 0 0 0 0 0 1 1
6 0.0 40 0.0 2 1.0 0 0 0 0 1 1 1
4 1.0 5 0.0 4 1.0 0 0 0 0 1 1 0
6 0.9 3 0.0 7 0.0 0 0 0 0 1 1 0
2 1.0 5 0.0 0 0.0 0 0 1 0 1 1 0
12 1.0 2 0.0 12 1.0 0 0 0 0 1 1 0
3 0.0 4 1.0 3 1.0 0 0 0 0 0 1 0
2 0.0 5 0.0 0 0.0 0 0 0 0 0 1 0
40 0.0 40 0.0 0 0.0 0 0 0 1 1 1 1
40 0.0 0 0.0 0 0.0 0 0 0 1 0 1 1
12 0.1 50 0.0 40 0.0 0 0 0 1 1 1 1
5 0.0 0 0.0 0 0.0 0 0 0 1 1 1 1
9 0.0 60 0.0 40 0.0 0 1 0 1 1 0 1
30 0.0 5 0.0 40 0.0 0 1 0 1 0 0 1
5 0.0 3 1.0 2 1.0 0 0 0 1 0 0 0
4 1.0 4 1.0 5 1.0 0 0 0 1 0 1 0
8 0.9 60 0.0 8 0.9 0 1 0 1 0 0 0
1 0.0 1 0.0 0 0.0 0 1 0 0 0 0 1
1 0.0 4 0.0 1 0.0 0 1 0 0 0 0 1
4 0.0 2 0.0 0 0.0 0 1 0 0 0 0 1
5 0.0 4 0.0 5 0.0 0 0 0 0 1 0 0
4 0.0 8 0.0 0 0.0 0 0 0 0 1 0 0
7 0.0 90 0.0 6 0.0 0 0 0 0 1 0 0
3 0.0 0 0.0 9 0.0 0 0 0 0 1 0 0
3 0.0 2 1.0 3 1.0 0 0 0 0 1 1 1
12 0.0 5 1.0 2 1.0 0 0 0 0 1 1 1
6 0.8 3 0.9 30 0.0 0 0 0 1 1 1 0
"""


class Tree:
    """A binary decision tree by Gini impurity; ties go to the first feature and the lowest cut."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8):
        self.answer, self.feature = bool(labels.mean() > 0.5), None
        if depth == 0 or labels.min() == labels.max():
            return
        best = None
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] < cut
                cost = sum(len(y) * 2 * y.mean() * (1 - y.mean()) for y in (labels[left], labels[~left]))
                if best is None or cost < best[0] - 1e-12:
                    best = cost, f, cut
        if best is None:
            return
        _, self.feature, self.cut = best
        left = rows[:, self.feature] < self.cut
        self.left, self.right = Tree(rows[left], labels[left], depth - 1), Tree(rows[~left], labels[~left], depth - 1)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(rows), self.answer)
        left = rows[:, self.feature] < self.cut
        out = np.empty(len(rows), bool)
        out[left], out[~left] = self.left.predict(rows[left]), self.right.predict(rows[~left])
        return out


@lru_cache(maxsize=1)
def tree() -> Tree:
    table = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return Tree(table[:, :-1], table[:, -1])


def _words(value: str) -> tuple[set[str], set[str], set[str]]:
    """Words of the names in a class or id: what they name, the other frame words in them, and all, but for those that only modify a layout.

    A name names its last word, or the last before words like *wrap* or *box*: ``reader-comments`` are comments, ``ad-slot`` is an ad, while ``share-price`` and ``comment-on-the-budget``
    only hold such a word.
    """
    named, held, all_ = set(), set(), set()
    for name in value.split():
        words = [w.lower() for w in _PART.findall(name) if len(w) > 1]
        words = words[: next((i for i, w in enumerate(words) if w in _MODIFIERS), None)]
        if not _WRAPS.isdisjoint(words) and not {"content", "main"}.isdisjoint(words):
            words = [w for w in words if w not in ("side", "sidebar")]
        for i in reversed(range(len(words) - 1)):
            if tuple(words[i : i + 2]) in _PAIRS:
                words[i : i + 2] = [_PAIRS[tuple(words[i : i + 2])]]
        all_.update(words)
        while len(words) > 1 and words[-1] in _SHOWN:
            words.pop()
        named.update(words[-1:])
        held.update(words[:-1])
    return named, held & _FRAME_WORDS, all_


def _role(name: str, rest: str, in_article: bool) -> tuple[bool, set[str], bool, bool, str]:
    """Whether an element belongs to the frame of the page, the words it is named by that say so too, whether such a word is in its name, whether it holds an article, and as which element."""
    frame, main, kind = name in _FRAME_TAGS or (name == "header" and not in_article), name in _MAIN_TAGS, name
    words: set[str] = set()
    named: set[str] = set()
    hint = False
    for key, *values in _ATTRIBUTE.findall(rest) if rest else ():
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            frame = True
        elif key == "role" and value.lower() in _MAIN_TAGS:
            main, kind = True, value.lower()
        elif key in ("class", "id", "role"):
            own, held, all_ = _words(value)
            named, words, hint = named | own, words | all_, hint or bool(held)
    hit: set[str] = set()
    if words and name not in ("html", "body"):
        hit = named & _FRAME_WORDS
        if name == "form":
            hit.discard("form")
        # The header of an article or an entry is its own; the article element's class may name topics.
        if main or (hit == {"header"} and (in_article or words & _ARTICLE_WORDS)):
            hit = set()
        main |= bool(words & _MAIN_WORDS) and not hit
    return frame, hit, hint and name not in ("html", "body"), main, kind


def _framed(rows: np.ndarray, forms: list[int], articles: int) -> np.ndarray:
    """Whether each block is in the frame, as all of the page is known."""
    n, hard, soft, free = rows[:, 0], rows[:, 2] > 0, rows[:, 3] > 0, rows[:, 4] > 0
    formed, form, article = rows[:, 6:9].T.astype(int)
    wide = np.zeros(len(forms) + 1, bool)
    if forms:
        sizes = np.bincount(form + 1, n * ~(hard | soft & free), len(forms) + 1)
        for i in range(len(forms) - 1, -1, -1):
            # The first place is that of no form, and ends with the words of the page.
            sizes[forms[i] + 1] += sizes[i + 1]
        wide[:-1] = (sizes[1:] >= FORM_SHARE * sizes[0]) & (sizes[1:] > 0)
    hard = hard | (formed >= 0) & ~wide[formed]
    if articles:
        inside = (article >= 0) & ~hard
        outside, ended = (np.bincount(article[k], n[k], articles).max() for k in (inside & ~soft, inside & soft & ~free))
        if ended > outside:
            soft = free
    return hard | soft


def blocks_of(page: str) -> tuple[list[str], np.ndarray]:
    """The texts of the page's blocks and their features."""
    texts, rows = [], []
    # What holds the text: a frame element, class words of a frame, the same unless an article ended it, class words of a frame with articles of its own,
    # the form that is a frame, the form round all, the article, whether there is one by name or words, a heading, a name with a frame's word in it.
    here = (False, False, False, False, -1, -1, -1, False, False, False)
    # Open block elements: name, what held them.
    stack: list[tuple[str, tuple]] = []
    # For each form the one round it; the number of articles.
    forms: list[int] = []
    articles = 0
    held: list[str] = []
    words = linked = 0
    link = -1

    def close() -> None:
        nonlocal held, words, linked
        if words:
            text = " ".join("".join(held).split())
            prose = bool(stack) and stack[-1][0] in _PROSE or text.endswith(_STOPS)
            texts.append(text)
            rows.append((words, linked / words, *here, prose))
        held, words, linked = [], 0, 0

    def pop() -> None:
        nonlocal here, link
        _, here = stack.pop()
        if link > len(stack):
            link = -1

    def text(piece: str) -> None:
        nonlocal words, linked
        piece = html.unescape(piece)
        n = len(piece.split())
        held.append(piece)
        words += n
        linked += n * (link >= 0)

    at = 0
    # Raw elements that nothing ends from here on.
    unended: set[str] = set()
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            text(page[at : token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        ending = bool(token["end"] or token["end2"])
        if name in _RAW:
            foreign_end = name == "svg" and (token["rest"] or token["rest2"] or "").endswith("/")
            if not ending and not foreign_end and name not in unended:
                close_tag = _RAW[name].search(page, at)
                if close_tag:
                    at = close_tag.end()
                elif name in _UNENDING:
                    at = len(page)
                else:
                    unended.add(name)
        elif name == "a":
            link = -1 if ending else len(stack)
        elif name == "br":
            held.append(" ")
        elif name in _BLOCKS:
            close()
            if not ending:
                if name not in _VOID:
                    if stack and (stack[-1][0] == "p" or stack[-1][0] == name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                        pop()
                    if name == "body":
                        while stack and stack[-1][0] == "head":
                            pop()
                    hard, soft, free, own, formed, form, article, main, heading, hint = here
                    f, hit, held_word, m, kind = _role(name, token["rest"] or token["rest2"], main)
                    if kind in _MAIN_TAGS:
                        free, formed = free and own and kind != "main", -1
                        if kind == "main":
                            soft = own = False
                        if article < 0:
                            article, articles = articles, articles + 1
                    elif name == "form":
                        forms.append(form)
                        formed = form = len(forms) - 1
                    soft, free, own = soft or bool(hit), free or bool(hit), own or not hit.isdisjoint(_OWN_ARTICLES)
                    stack.append((name, here))
                    here = (hard or f, soft, free, own, formed, form, article, main or m, heading or name in _HEADINGS, hint or held_word)
            elif any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
    if at < len(page):
        text(page[at:])
    close()
    all_ = np.array(rows, float).reshape(-1, 13)
    framed = _framed(all_, forms, articles)
    lone = np.full(len(all_), not (all_[:, 9].astype(bool) & ~framed).any())
    own = np.column_stack([all_[:, :2], framed, all_[:, 9:], lone])
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1, :2]]), np.concatenate([own[1:, :2], edge])
    return texts, np.concatenate([own[:, :2], before[: len(own)], after[: len(own)], own[:, 2:]], axis=1)


def main_text(page: str | None) -> str:
    texts, rows = blocks_of(page or "")
    if not texts:
        return ""
    return "\n\n".join(t for t, keep in zip(texts, tree().predict(rows), strict=True) if keep)


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, ``text`` and ``n_chars``, its code points, for every row."""
    row = df.select(*keep).schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "page"):
            texts = [main_text(p) for p in part.column("page").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), sizes], ["row", "text", "n_chars"])

    plain = df.select(F.col(page).alias("page"), F.struct(*keep).alias("row"))
    made = arrow_map(plain, run, f"row {row}, text string, n_chars long")
    return made.select(*[F.col(f"row.{c}") for c in keep], "text", "n_chars")
