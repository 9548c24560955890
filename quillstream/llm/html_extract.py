"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Nodes are block elements, and runs of text beside block elements. Trees give each node the log-odds that it holds main
text, from its subtree's density, links, attribute tokens, depth and siblings. A node that holds main text is inside
nodes that do, so decoding picks the likeliest labelling in which no node is in whose parent is out. That is a maximum
over the tree, found from the leaves up.

Pages carry no labels, so the trees learn from pages that ``synthetic_pages`` writes, whose main text is known.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import boosting
from quillstream.llm.common import frugal, small_batches

#: Elements that stand as blocks; others run on in their block's text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td"
    " tfoot th thead tr ul head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, whatever stands in it; never part of any text here.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose whole subtree is never part of any text.
UNSEEN = frozenset("noscript template svg object math canvas audio video button datalist".split())
#: An open element on the left ends where one on the right begins.
_ENDS = {
    "p": BLOCKS - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
    "head": {"body"},
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What ends a tag, or begins a quoted value in it.
_IN_TAG = re.compile(r"=\s*([\"'])|>")
TEXT_TOKEN, OPEN, CLOSE, DROPPED = range(4)


def tokens(source: str) -> Iterator[tuple[int, str, str, bool]]:
    """(kind, text or tag name, attributes, whether a slash ends the tag) of a page, in time linear in its length.

    A quoted value ends at its quote, and a quote without a partner is a character like others. A tag that the page's end
    cuts off is dropped. A raw element without an end tag, or one that a slash ends, has no content; scripts and styles
    without an end tag reach to the page's end, as in browsers. A comment without an end is one up to the next '>'.
    """
    n, at = len(source), 0
    low = source.lower() if source.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), source)
    last = {q: source.rfind(q) for q in "\"'"}
    ends: dict[str, int] = {}  # the next end tag of each raw element, as far as it was looked for
    while at < n:
        here = source.find("<", at)
        if here != at:
            here = n if here < 0 else here
            yield TEXT_TOKEN, source[at:here], "", False
            at = here
            continue
        m = _TAG.match(source, at)
        if not m:
            if source.startswith("<!--", at):
                stop = at + 4 + (2 if source.startswith("->", at + 4) else 1) if source.startswith((">", "->"), at + 4) else source.find("-->", at + 4) + 3
                stop = stop if stop > 2 else source.find(">", at) + 1
            elif source.startswith(("<!", "<?", "</"), at):
                stop = source.find(">", at) + 1
            else:
                yield TEXT_TOKEN, "<", "", False
                at += 1
                continue
            at = stop or n
            yield DROPPED, "", "", False
            continue
        stop = m.end()
        while found := _IN_TAG.search(source, stop):
            stop = found.end()
            if not found[1]:
                break
            if last[found[1]] >= stop:
                stop = source.index(found[1], stop) + 1
        else:
            return
        tag, rest = m[2].lower(), source[m.end() : stop - 1]
        closed = rest.endswith("/")
        if m[1]:
            yield CLOSE, tag, "", False
        elif tag in RAW:
            yield DROPPED, tag, "", False
            if ends.get(tag, -1) < stop:
                found = low.find(f"</{tag}", stop)
                ends[tag] = found if found >= 0 else n
            end = ends[tag]
            code = tag in ("script", "style")
            again = low.find(f"<{tag}", stop, end) if closed else -1
            if closed and not (code and end < n and again < 0) or end == n and not code:
                at = stop
                continue
            stop = source.find(">", end) + 1 or n
        else:
            yield OPEN, tag, rest, closed
        at = stop


def unseen_ends(found: list[tuple[int, str, str, bool]]) -> dict[int, int]:
    """Where unseen elements end, by the place of their tag: at their end tag, else before the next block's tag."""
    out: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for i, (kind, tag, _, closed) in enumerate(found):
        if tag in UNSEEN and kind == OPEN:
            if closed:
                out[i] = i
            else:
                waiting.setdefault(tag, []).append(i)
        elif tag in UNSEEN and kind == CLOSE and waiting.get(tag):
            out[waiting[tag].pop()] = i
    rest = sorted((i for own in waiting.values() for i in own), reverse=True)
    if rest:
        block = len(found)
        for i in range(len(found) - 1, -1, -1):
            if rest and i == rest[0]:
                out[rest.pop(0)] = block - 1
            if found[i][0] in (OPEN, CLOSE) and found[i][1] in BLOCKS:
                block = i
    return out


_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_STOPS = re.compile(r"[.,;:!?]")
ROOT, TEXT = "#root", "#text"


class Page:
    """Nodes in page order, a parent before its children; node 0 is the page."""

    __slots__ = ("commas", "controls", "links", "names", "parents", "tags", "texts", "own_tags")

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.names = [ROOT], [-1], [()]
        self.texts: list[list[str]] = [[]]
        self.links, self.own_tags, self.controls = [0], [0], [0]
        self._build(source)

    def _open(self, tag: str, parent: int, names: tuple) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.texts.append([])
        self.links.append(0)
        self.own_tags.append(0)
        self.controls.append(0)
        return len(self.tags) - 1

    def _build(self, source: str) -> None:
        stack, link, run = [0], 0, 0  # run: the node that text goes to now
        held: Counter[str] = Counter()  # open elements by tag
        found = list(tokens(source))
        ends = unseen_ends(found)
        at = -1
        while (at := at + 1) < len(found):
            kind, tag, rest, _ = found[at]
            if kind == TEXT_TOKEN:
                piece = html.unescape(tag) if "&" in tag else tag
                if run < 0:
                    if not piece.strip():
                        continue
                    run = self._open(TEXT, stack[-1], ())
                self.texts[run].append(piece)
                if link:
                    self.links[run] += len(piece.strip())
                continue
            if kind == DROPPED or kind == OPEN and tag in UNSEEN:
                self.own_tags[stack[-1]] += tag != ""
                self.controls[stack[-1]] += tag in ("textarea", "button")
                at = ends.get(at, at)
                continue
            if tag not in BLOCKS:
                self.own_tags[stack[-1]] += kind == OPEN
                if tag == "a":
                    link = kind == OPEN
                elif tag == "br":
                    if run >= 0:
                        self.texts[run].append(" ")
                elif tag == "input":
                    self.controls[stack[-1]] += 1
                continue
            link = 0
            if kind == CLOSE:
                for depth in range(len(stack) - 1, 0, -1) if held[tag] else ():
                    if self.tags[stack[depth]] == tag:
                        held.subtract(self.tags[i] for i in stack[depth:])
                        del stack[depth:]
                        break
                    if self.tags[stack[depth]] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "body", "html"):
                        break
                run = -1
                continue
            while len(stack) > 1 and tag in _ENDS.get(self.tags[stack[-1]], ()):
                held[self.tags[stack.pop()]] -= 1
            if tag == "hr":
                run = -1
                continue
            named = _NAMES.findall(rest) if rest else ()
            names = tuple(x.lower() for parts in named for x in _PARTS.findall(parts[0] or parts[1] or parts[2]))
            stack.append(self._open(tag, stack[-1], names))
            held[tag] += 1
            run = stack[-1]
        for i, parts in enumerate(self.texts):
            self.texts[i] = " ".join("".join(parts).split())


def _sums(values: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Of each node's subtree; a parent stands before its children."""
    out = values.tolist()
    for i in range(len(out) - 1, 0, -1):
        if parents[i] >= 0:
            out[parents[i]] += out[i]
    return np.array(out, float)


def _from_above(values: list[float], parents: list[int], pick) -> np.ndarray:
    out = list(values)
    for i, p in enumerate(parents):
        if p >= 0:
            out[i] = pick(out[i], out[p])
    return np.array(out)


@dataclass
class Lexicon:
    """Log-odds of main text for tags and attribute tokens, as counted on training pages."""

    tags: dict[str, float]
    names: dict[str, float]

    @staticmethod
    def count(pages: list[Page], truth: list[np.ndarray], least: int = 3) -> Lexicon:
        out = []
        for own in (lambda p, i: (p.tags[i],), lambda p, i: set(p.names[i])):
            seen: dict[str, list[int]] = {}
            for page, y in zip(pages, truth):
                for i in range(len(page.tags)):
                    for x in own(page, i):
                        seen.setdefault(x, [0, 0])[int(y[i])] += 1
            out.append({x: math.log((b + 1) / (a + 1)) for x, (a, b) in seen.items() if a + b >= least})
        return Lexicon(*out)


def features(pages: list[Page], lexicon: Lexicon) -> np.ndarray:
    """A row for each node of each page."""
    out = []
    for page in pages:
        n = len(page.tags)
        parents = page.parents
        up = np.array(parents)
        size = np.fromiter(map(len, page.texts), float, n)
        text, links, tags, controls = (_sums(x, parents) for x in (size, np.array(page.links), np.array(page.own_tags) + 1, np.array(page.controls)))
        stops = _sums(np.fromiter((len(_STOPS.findall(t)) for t in page.texts), float, n), parents)
        paragraphs = _sums(np.fromiter((t == "p" or t == TEXT for t in page.tags), float, n), parents)
        headings = _sums(np.fromiter((t == "h1" for t in page.tags), float, n), parents)
        tag = [lexicon.tags.get(t, 0.0) for t in page.tags]
        known = [[lexicon.names[x] for x in names if x in lexicon.names] for names in page.names]
        low, high = [min(x, default=0.0) for x in known], [max(x, default=0.0) for x in known]
        depth = _from_above([0.0] * n, parents, lambda own, above: above + 1)
        low_above = _from_above(low, parents, min)
        tag_above = _from_above(tag, parents, min)
        safe = np.maximum(up, 0)
        of_parent = np.bincount(safe, minlength=n)[safe].astype(float)
        sibling_text = (np.bincount(safe, text, n)[safe] - text) / np.maximum(1, of_parent - 1)
        sibling_links = (np.bincount(safe, links, n)[safe] - links) / np.maximum(1, np.bincount(safe, text, n)[safe] - text)
        some = np.maximum(1, text)
        tag_array = np.array(tag)
        out.append(
            np.stack(
                [
                    tag_array, tag_array[safe], tag_above, np.array(low), np.array(high), np.array(low)[safe], low_above, depth, np.log1p(text),
                    links / some, 100 * tags / some, text / max(1, text[0]), links[safe] / np.maximum(1, text[safe]), stops / some * 100, paragraphs,
                    headings, controls, np.minimum(of_parent, 50), np.log1p(sibling_text), sibling_links, np.log1p(text) - np.log1p(sibling_text), np.log1p(size),
                ],
                1,
            )
        )
    return np.concatenate(out)


def decode(log_odds: list[float], parents: list[int]) -> list[bool]:
    """The likeliest labelling in which no node is in whose parent is out."""
    n = len(parents)
    # likelihoods of in and out: log p and log (1 - p), each with what the children add
    inside = [-math.log1p(math.exp(-max(-30.0, min(30.0, s)))) for s in log_odds]
    outside = [-math.log1p(math.exp(max(-30.0, min(30.0, s)))) for s in log_odds]
    for i in range(n - 1, 0, -1):
        inside[parents[i]] += max(inside[i], outside[i])
        outside[parents[i]] += outside[i]
    out = [False] * n
    for i in range(n):
        out[i] = inside[i] > outside[i] and (i == 0 or out[parents[i]])
    return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: boosting.Boosted

    def extract(self, sources: list[str]) -> list[str]:
        """The main text of each page."""
        pages = [Page(s) for s in sources]
        if not pages:
            return []
        scores = self.trees.log_odds(features(pages, self.lexicon)).tolist()
        out, first = [], 0
        for page in pages:
            n = len(page.tags)
            keep = decode(scores[first : first + n], page.parents)
            out.append(" ".join(t for t, k in zip(page.texts, keep) if k and t))
            first += n
        return out


#: Tokens of class and id attributes that training pages use for each kind of block.
NAMES = {
    "menu": "nav navbar menu navigation topnav mainmenu site-nav breadcrumb breadcrumbs tabs toc pagination pager skip-links".split(),
    "header": "header site-header masthead topbar banner logo branding page-header".split(),
    "footer": "footer site-footer colophon copyright legal bottom foot page-footer".split(),
    "sidebar": "sidebar side widget widgets rail related related-posts popular trending recommended more-stories see-also secondary".split(),
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert banner-notice popup modal overlay disclaimer warning paywall announcement".split(),
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner-ad ad-slot adbox dfp".split(),
    "form": "form newsletter subscribe signup login search search-form contact-form feedback register".split(),
    "comments": "comments comment comment-list discussion disqus replies responses respond reader-comments user-comments thread".split(),
    "share": "share social sharing share-buttons tools tags meta byline-tools print follow".split(),
    "content": "content article post entry entry-content article-body post-content story story-body main main-content text body-text page-content markdown hentry document documentation".split(),
    "neutral": "container wrapper row col inner wrap box section block group page layout grid clearfix".split(),
}
_TAGS = {
    "menu": ("nav", "nav", "div", "ul"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"),
    "sidebar": ("aside", "aside", "div", "section"), "notice": ("div", "div", "section", "p"), "advert": ("div", "div", "aside", "section"),
    "form": ("form", "form", "div", "section"), "comments": ("section", "div", "div", "ol"), "share": ("div", "ul"),
}


#: Landmark roles that pages give to each kind of block.
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search", "content": "main"}


def synthetic_pages(n: int, seed: int = 9) -> Iterator[tuple[str, str]]:
    """(html, main text) of invented pages: several layouts, named and unnamed blocks, closed and unclosed tags."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwyp"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2, 3, 4, 5, 6, 8, 10))))

    def prose(least: int, most: int) -> str:
        words = [word() for _ in range(rng.randint(least, most))]
        for i in range(len(words)):
            if rng.random() < 0.08:
                words[i] += rng.choice(",.")
        out = " ".join(words).capitalize() + rng.choice(("", ".", ".", "."))
        style = rng.random()
        if style < 0.04:
            out = out.upper().replace(" ", "!! ")
        elif style < 0.08:
            out = out.replace(" ", rng.choice(("### ", "*** ", "%%% ", " | ")))
        return out

    def attrs(kind: str, sure: float) -> str:
        if rng.random() > sure:
            return ""
        names = [rng.choice(NAMES[kind])] + [rng.choice(NAMES["neutral"])] * (rng.random() < 0.2)
        if kind in ROLES and rng.random() < 0.15:
            return f' role="{ROLES[kind]}"' + f' class="{names[0]}"' * (rng.random() < 0.5)
        return f' {rng.choice(("class", "class", "id"))}="{" ".join(names)}"'

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def boilerplate(kind: str) -> str:
        tag = rng.choice(_TAGS[kind])
        # a plain div needs a name to be told from main text; elements that say what they are may go without
        head = f"<{tag}{attrs(kind, 0.5 if tag in ('nav', 'header', 'footer', 'aside', 'form') else 1.0)}>"
        items = "".join(f"<li>{link(prose(1, 4))}</li>" for _ in range(rng.randint(2, 9)))
        if kind == "menu":
            inner = items if tag == "ul" else f"<ul>{items}</ul>" if rng.random() < 0.7 else " ".join(link(word()) for _ in range(6))
        elif kind == "header":
            inner = f"<h1>{prose(1, 4)}</h1>" * (rng.random() < 0.3) + f"<p>{prose(2, 12)}</p>" * (rng.random() < 0.5) + f"<div>{link(word())}</div>"
            inner += boilerplate("menu") * (rng.random() < 0.4)
        elif kind == "footer":
            inner = rng.choice((f"&copy; {word()} &middot; {prose(2, 25)}", f"<p>&copy; 2020 {prose(1, 20)}</p>", f"<ul>{items}</ul><p>{prose(2, 9)}</p>"))
        elif kind == "sidebar":
            inner = f"<h3>{prose(1, 4)}</h3>" + rng.choice((f"<ul>{items}</ul>", f"<p>{prose(5, 60)}</p>", f"<p>{prose(4, 20)}</p>" * 3))
        elif kind in ("notice", "advert"):
            inner = rng.choice((prose(2, 25), prose(2, 25), f"<p>{prose(3, 40)}</p>", f"<p>{prose(3, 30)}</p><p>{link(word())}</p>"))
            inner = prose(2, 20) if tag == "p" else inner
        elif kind == "form":
            inner = f"<p>{prose(2, 15)}</p><label>{word()} <input name=q></label><button>{word()}</button>" + f"<select><option>{word()}<option>{word()}</select>" * (rng.random() < 0.3)
        elif kind == "comments":
            one = lambda: f"<{'li' if tag == 'ol' else 'div'}{attrs('comments', 0.6)}><p>{prose(3, 60)}</p></{'li' if tag == 'ol' else 'div'}>"
            inner = f"<h3>{prose(1, 3)}</h3>" * (tag != "ol") + "".join(one() for _ in range(rng.randint(1, 6)))
        else:
            inner = items if tag == "ul" else " ".join(link(word()) for _ in range(4))
        return f"{head}{inner}</{tag}>"

    for _ in range(n):
        body: list[str] = []
        parts: list[str] = []

        def own(text: str, before: str, after: str, parts: list[str] = parts) -> str:
            parts.append(text)
            marked = text.split(" ")
            if len(marked) > 6 and rng.random() < 0.4:
                i = rng.randrange(len(marked) - 2)
                marked[i] = rng.choice((f"<b>{marked[i]}</b>", f"<em>{marked[i]}</em>", link(marked[i])))
            return before + " ".join(marked) + after

        def content(parts: list[str] = parts) -> str:
            out = own(prose(2, 10), "<h1>", "</h1>") if rng.random() < 0.8 else ""
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 14))):
                kind = rng.random()
                if kind < 0.72:
                    before, after = rng.choice((("<p>", "</p>"), ("<p>", "</p>"), ("<p>", "<br>"), ("<p><b>", "<br>"), ("<div>", "</div>")))
                    out += own(prose(1, rng.choice((6, 30, 120))), before, after)
                elif kind < 0.8:
                    out += own(prose(1, 9), "<h2>", "</h2>")
                elif kind < 0.86:
                    out += "<ul>" + "".join(own(prose(1, 20), "<li>", "</li>") for _ in range(rng.randint(1, 5))) + "</ul>"
                elif kind < 0.9:
                    out += own(prose(4, 40), "<blockquote>", "</blockquote>")
                elif kind < 0.92:
                    head = "<thead><tr>" + "".join(own(prose(1, 3), "<th>", "</th>") for _ in range(2)) + "</tr></thead>" if rng.random() < 0.4 else ""
                    out += f"<table>{head}<tr>" + "".join(own(prose(1, 4), "<td>", "</td>") for _ in range(4)) + "</tr></table>"
                elif kind < 0.935:
                    out += "<dl>" + "".join(own(prose(1, 2), "<dt>", "</dt>") + own(prose(2, 14), "<dd>", "</dd>") for _ in range(rng.randint(1, 4))) + "</dl>"
                elif kind < 0.945:
                    out += own(prose(3, 20), *rng.choice((("<pre>", "</pre>"), ("<pre><code>", "</code></pre>"), ("<figure><img src=x><figcaption>", "</figcaption></figure>"))))
                else:
                    out += boilerplate(rng.choice(("advert", "share", "notice", "form", "sidebar")))
            return out

        inner = content()
        if rng.random() < 0.12:  # chapters in sections
            inner = "".join(f"<section{' id=' + word() if rng.random() < 0.5 else ''}>{x}</section>" for x in (inner, *(content() for _ in range(rng.randint(0, 3)))) if x)
        if not parts:
            inner += own(prose(3, 80), "<p>", "</p>")
        shape = rng.random()
        if shape < 0.45:
            inner = f"<article{attrs('content', 0.3)}>{inner}</article>"
        elif shape < 0.6:
            inner = f"<main{attrs('content', 0.3)}>{inner}</main>"
        elif shape < 0.9:
            inner = f"<div{attrs('content', 1.0)}>{inner}</div>"
        else:
            inner = f"<div>{inner}</div>"
        if rng.random() < 0.3:
            inner = f"<main>{inner}{boilerplate('comments') if rng.random() < 0.4 else ''}</main>"
        before = [boilerplate(k) for k in ("header", "menu", "notice", "advert") if rng.random() < 0.5]
        after = [boilerplate(k) for k in ("share", "comments", "sidebar", "form", "advert", "menu", "footer", "notice") if rng.random() < (0.7 if k == "footer" else 0.3)]
        rng.shuffle(before)
        body += before
        if rng.random() < 0.3:
            inner = f"<div{attrs('neutral', 0.7)}>{''.join([boilerplate('sidebar')] * (rng.random() < 0.3))}{inner}{''.join([boilerplate('sidebar')] * (rng.random() < 0.3))}</div>"
        body += [inner, *after]
        tail = "</body></html>" if rng.random() < 0.9 else ""
        yield f"<!DOCTYPE html><html><head><title>{prose(1, 9)}</title><style>p{{}}</style><script>x='</p>'</script></head><body>{''.join(body)}{tail}", " ".join(" ".join(html.unescape(p).split()) for p in parts)


def _truth(page: Page, main: str) -> np.ndarray:
    """Nodes that hold a part of the main text; parts are met in page order."""
    out = np.zeros(len(page.tags), bool)
    at = 0
    for i, text in enumerate(page.texts):
        if text and main.startswith(text, at):
            at += len(text) + 1
            out[i] = True
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] |= out[i]
    return out


@functools.lru_cache(maxsize=4)
def train(pages: int = 4000, seed: int = 9) -> Model:
    """Trees from invented pages; the same for equal arguments, and kept while the driver runs."""
    made = [(Page(source), main) for source, main in synthetic_pages(pages, seed)]
    truth = [_truth(p, main) for p, main in made]
    half = len(made) // 2  # tokens are counted on other pages than those that the trees see
    lexicon = Lexicon.count([p for p, _ in made[:half]], truth[:half])
    x = features([p for p, _ in made[half:]], lexicon)
    return Model(lexicon, boosting.fit(x, np.concatenate(truth[half:]).astype(float)))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """SCHEMA for each row of pages.

    Null and empty pages, and pages without main text, have the empty text. Unclosed and stray tags are put right as
    browsers do, by and large; a page cut off anywhere is read as far as it goes, and what an element without an end tag
    hides ends at the next block. Ids and urls may be null or repeated; equal pages have equal results. Of equally likely
    labellings the one with less text is taken. A page costs time and memory in proportion to its length; other columns
    are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees and a word list of NAMES' size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = sent.value.extract([x.as_py() or "" for x in part.column(2)])
                n_chars = pa.array(list(map(len, texts)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), n_chars], [x.split()[0] for x in SCHEMA.split(", ")])

    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(frugal(run), SCHEMA)
