"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between borders of block-level elements.  Each block is described by the
tags, classes, ids and roles of its ancestors and by its text (length, share of links, punctuation, cue
words, place).  The field scores the labels main and other for all blocks together and Viterbi picks the best
labelling; main blocks are the text.

Training uses labelled pages: a bounded sample of the pages themselves (SAMPLE_PAGES and SAMPLE_BYTES, by hash of page_id) where
semantic elements mark the article, and BUILT_PAGES pages that are put together from the sample's paragraphs in
many layouts (menus, notices, adverts, forms, sidebars and reader comments around and inside the article), with known
labels.  Training is deterministic.

A null or empty page gives an empty text.  White space (line breaks, <br> and no-break spaces too) becomes one space,
character references are decoded, blocks are joined by an empty line.  Rows are worked on one by one, so repeated
rows need no care; extra columns are ignored; without any page the field is trained on built pages alone.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import staged

SAMPLE_PAGES, BUILT_PAGES = 200, 800
#: Bytes of the sampled pages together.
SAMPLE_BYTES = 16 << 20
EPOCHS, RATE, DECAY = 8, 0.3, 1e-4

#: Elements that begin and end blocks, elements without content, and elements whose content is never text.
BLOCKS = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead "
    "tbody tfoot tr td th form fieldset legend blockquote pre figure figcaption address details summary dialog center hr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that ends with the page if it is not closed, and content that then ends at the next tag.
RAW = frozenset("script style noscript template iframe textarea title".split())
SKIPPED = RAW | frozenset("svg select button object canvas audio video".split())
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_EVENT = re.compile("[>\"']")
_TAG = re.compile("<[a-zA-Z/]")
_CLOSED = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in SKIPPED}
_NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Opening one of these ends an open element of the second kind.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = frozenset(("ul", "ol", "dl", "table"))


class Tokens:
    """Text and tags of a page in order: (text, "", "", "") or ("", "/" or "", tag, attributes).

    Every part of the page is looked at a bounded number of times, whatever its markup: searches that found
    nothing are not made again, and a scan for the end of a tag gives up where an earlier one went in vain.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in (">", '"', "'")}
        self.comment = page.rfind("-->")
        self.vain: set[int] = set()
        self.unclosed: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Place behind the tag whose attributes begin at `at`, -1 if there is none.

        Quoted values may hold any sign; quotes without a partner leave the tag to end at the first ">".
        """
        page, last = self.page, self.last
        if at > last[">"]:
            return -1
        seen, i = [], at
        while i <= last[">"]:
            event = _EVENT.search(page, i)
            place = event.start()
            if page[place] == ">":
                return place + 1
            if place in self.vain or place >= last[page[place]]:
                break
            seen.append(place)
            i = page.find(page[place], place + 1) + 1
        self.vain.update(seen)
        return page.find(">", at) + 1

    def __iter__(self):
        page, at = self.page, 0
        while at < len(page):
            begin = page.find("<", at)
            if begin < 0:
                begin = len(page)
            if begin > at:
                yield page[at:begin], "", "", ""
            if begin == len(page):
                return
            at = begin
            if page.startswith("<!--", at):
                at = page.find("-->", at + 4) + 3 if at + 4 <= self.comment else len(page)
                continue
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at) + 1 if at < self.last[">"] else 0
            else:
                name = _OPEN.match(page, at)
                end = self.tag_end(name.end()) if name else 0
                if name and end > 0:
                    close, tag, attributes = name[1], name[2].lower(), page[name.end() : end - 1]
                    if tag in SKIPPED:
                        end = end if close or attributes.endswith("/") and tag not in RAW else self.content_end(tag, end)
                    else:
                        yield "", close, tag, attributes
            if end > 0:
                at = end
            else:
                yield "<", "", "", ""
                at += 1

    def content_end(self, tag: str, at: int) -> int:
        """Place behind an element whose content is no text."""
        if tag not in self.unclosed:
            found = _CLOSED[tag].search(self.page, at)
            if found:
                return found.end()
            self.unclosed.add(tag)
        if tag in RAW:
            return len(self.page)
        following = _TAG.search(self.page, at)
        return following.start() if following else len(self.page)


@dataclass(slots=True, eq=False)
class Element:
    """An open element; the chain of parents is the path of a block."""

    tag: str
    names: tuple
    parent: Element | None


@dataclass(slots=True)
class Block:
    text: str
    path: Element | None
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, and whether the element is hidden."""
    out = []
    for name, value in _NAMED.findall(attributes):
        name = name.lower()
        value = value.strip("\"'")
        if name in ("class", "id", "role"):
            out += [x.lower() for x in _PART.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or "display:none" in value.replace(" ", "").lower():
            out.append("hidden")
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked, anchor = 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
            parts.clear()
        linked = 0

    def leave(size: int):
        while len(stack) > size:
            opened[stack.pop().tag] -= 1

    for text, close, tag, attributes in Tokens(page):
        if not tag:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if anchor:
                linked += len(text.strip())
            continue
        if tag == "a":
            anchor = 0 if close else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if close:
                if opened[tag]:
                    leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
                continue
            if tag in VOID:
                continue
            if stack and stack[-1].tag == "p":
                leave(len(stack) - 1)
            ended = _ENDS.get(tag, ())
            if any(opened[x] for x in ended):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in _LISTS:
                        break
                    if stack[i].tag in ended:
                        leave(i)
                        break
            stack.append(Element(tag, _names(attributes), stack[-1] if stack else None))
            opened[tag] += 1
    flush()
    return out


#: Words whose presence in a short block says something; in the languages of common notices.
CUES = frozenset(
    "cookie cookies subscribe newsletter comment comments reply replies share tweet login register password search privacy "
    "terms copyright rights reserved advertisement sponsored related more next previous home about contact menu follow "
    "accept consent sign email posted wrote says ago kommentar kommentare antworten anzeige suche datenschutz impressum "
    "commentaire commentaires publicité rechercher comentario comentarios publicidad buscar".split()
)
_WORD = re.compile(r"[^\W\d_]+")


def _own(element: Element) -> list[str]:
    return [f"in {element.tag}", *[f"named {n}" for n in element.names]]


def _leaf(path: Element | None) -> list[str]:
    inner = path.tag if path else ""
    outer = path.parent.tag if path and path.parent else ""
    return [f"leaf {inner}", f"leaf {inner} of {outer}"]


def _path(element: Element | None) -> list[Element]:
    """Ancestors of a block, the outermost first."""
    out = []
    while element:
        out.append(element)
        element = element.parent
    return out[::-1]


def _path_features(path: Element | None) -> list[str]:
    return [feature for element in _path(path) for feature in _own(element)]


def features(page: list[Block]) -> list[list[str]]:
    """Features of every block, those of its ancestors first."""
    return [_path_features(b.path) + own for b, own in zip(page, block_features(page))]


def block_features(page: list[Block]) -> list[list[str]]:
    """Features of every block but for its ancestors."""
    out, n = [], len(page)
    for i, b in enumerate(page):
        size = len(b.text)
        share = 10 * b.linked // max(1, size)
        level = size.bit_length()
        own = [
            *_leaf(b.path),
            f"size {level}",
            f"links {min(4, (share + 1) // 2)}",
            f"end {b.text[-1] if b.text[-1] in '.!?:…»”' else 'w' if b.text[-1].isalnum() else 'o'}",
            f"begin {'u' if b.text[0].isupper() else 'l' if b.text[0].islower() else 'o'}",
            f"place {4 * i // n}",
            f"size {level} links {min(2, share // 3)}",
        ]
        if i == 0:
            own.append("first")
        if i == n - 1:
            own.append("last")
        if "©" in b.text:
            own.append("sign c")
        if "|" in b.text or "·" in b.text:
            own.append("sign bar")
        if size < 300:
            own += [f"cue {w}" for w in {x.lower() for x in _WORD.findall(b.text)} & CUES]
        out.append(own)
    return out


@dataclass
class Field:
    """Weights of the label main against other for each feature, and of label pairs (start is 2)."""

    weights: dict[str, float]
    pairs: list[list[float]]

    def scores(self, page: list[Block]) -> list[float]:
        get, sums = self.weights.get, {None: 0.0}

        def ancestors(path: Element | None) -> float:
            """Sum over a path; an element adds to the sum of its parent once."""
            chain = []
            while path not in sums:
                chain.append(path)
                path = path.parent
            total = sums[path]
            for element in reversed(chain):
                total = sums[element] = total + sum([get(f, 0.0) for f in _own(element)])
            return total

        return [ancestors(b.path) + sum([get(f, 0.0) for f in own]) for b, own in zip(page, block_features(page))]

    def labels(self, page: list[Block]) -> list[int]:
        """The best labelling, by Viterbi."""
        scores = self.scores(page)
        if not scores:
            return []
        p, back = self.pairs, []
        a, b = p[2][0], p[2][1] + scores[0]
        for s in scores[1:]:
            from_a, from_b = (0 if a + p[0][0] >= b + p[1][0] else 1), (0 if a + p[0][1] >= b + p[1][1] else 1)
            back.append((from_a, from_b))
            a, b = (a, b)[from_a] + p[from_a][0], (a, b)[from_b] + p[from_b][1] + s
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def marginals(scores: list[float], p: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Probability of main for each block, and expected counts of label pairs, by forward and backward sums."""
    n = len(scores)
    forward, backward = [(p[2][0], p[2][1] + scores[0])], [(0.0, 0.0)] * n
    for s in scores[1:]:
        a, b = forward[-1]
        forward.append((_sum(a + p[0][0], b + p[1][0]), _sum(a + p[0][1], b + p[1][1]) + s))
    for i in range(n - 2, -1, -1):
        a, b = backward[i + 1][0], backward[i + 1][1] + scores[i + 1]
        backward[i] = (_sum(p[0][0] + a, p[0][1] + b), _sum(p[1][0] + a, p[1][1] + b))
    total = _sum(*forward[-1])
    main = [math.exp(f[1] + g[1] - total) for f, g in zip(forward, backward)]
    counts = [[0.0, 0.0], [0.0, 0.0], [1 - main[0], main[0]]]
    for i in range(1, n):
        for x in (0, 1):
            for y in (0, 1):
                counts[x][y] += math.exp(forward[i - 1][x] + p[x][y] + (scores[i] if y else 0.0) + backward[i][y] - total)
    return main, counts


def train(pages: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Field of labelled pages (features of blocks, labels), by gradient ascent with a rate per weight."""
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    pairs, pairs_seen = [[0.0, 0.0] for _ in range(3)], [[0.0, 0.0] for _ in range(3)]
    for epoch in range(EPOCHS):
        order = list(range(len(pages)))
        random.Random(epoch).shuffle(order)
        for k in order:
            found, labels = pages[k]
            scores = [sum([weights.get(f, 0.0) for f in own]) for own in found]
            main, expected = marginals(scores, pairs)
            gradient: dict[str, float] = {}
            for own, label, m in zip(found, labels, main):
                if abs(label - m) > 1e-3:
                    for f in own:
                        gradient[f] = gradient.get(f, 0.0) + label - m
            for f, g in gradient.items():
                g -= DECAY * weights.get(f, 0.0)
                seen[f] = seen.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) + RATE * g / math.sqrt(seen[f] + 1e-6)
            before = 2
            for label in labels:
                expected[before][label] -= 1
                before = label
            for x in range(3):
                for y in range(2):
                    pairs_seen[x][y] += expected[x][y] ** 2
                    pairs[x][y] -= RATE * expected[x][y] / math.sqrt(pairs_seen[x][y] + 1e-6)
    return Field({f: w for f, w in weights.items() if abs(w) > 1e-4}, pairs)


#: Elements and names by which the sample's own pages mark their parts.
_OTHER_TAGS = frozenset("nav header footer aside form address dialog".split())
_OTHER_NAMES = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo menu nav navbar sidebar footer comment comments cookie notice "
    "newsletter share social related breadcrumb hidden popup modal".split()
)


def marked(page: list[Block]) -> list[int] | None:
    """Labels by semantic elements; None where the page has no article element."""
    inside = [any(e.tag in ("article", "main") for e in _path(b.path)) for b in page]
    if not any(inside):
        return None

    def other(b: Block) -> bool:
        return any(e.tag in _OTHER_TAGS or _OTHER_NAMES.intersection(e.names) for e in _path(b.path))

    return [int(i and not other(b)) for i, b in zip(inside, page)]


class Builder:
    """Pages in many layouts with known labels; `long` and `short` are texts to fill them with."""

    def __init__(self, long: list[str], short: list[str], seed: int):
        self.random = random.Random(seed)
        self.long = long or ["This is a paragraph of some length, with a few words in it. It says little, but it ends well."]
        self.short = short or ["Home", "About us", "News", "Contact"]

    def one(self, *choices):
        return self.random.choice(choices)

    def words(self, low: int, high: int) -> str:
        text = self.random.choice(self.long).split()
        at = self.random.randrange(max(1, len(text) - high))
        return html.escape(" ".join(text[at : at + self.random.randint(low, high)]))

    def paragraph(self) -> str:
        return html.escape(self.random.choice(self.long)) if self.random.random() < 0.8 else self.words(1, 12)

    def links(self, n: int) -> str:
        items = [f'<li><a href="/{i}">{html.escape(self.random.choice(self.short))[:40]}</a></li>' for i in range(n)]
        return f"<ul>{''.join(items)}</ul>"

    def wrapped(self, inner: str, tags: list[str], names: list[str]) -> str:
        tag = self.random.choice(tags)
        name = self.random.choice(names)
        how = self.one(f' class="{name}"', f' id="{name}"', f' class="{name} box"', f' class="site-{name}"')
        if tag not in ("div", "section", "p") and self.random.random() < 0.4:
            how = ""
        return f"<{tag}{how}>{inner}</{tag}>"

    def other(self, kind: str) -> str:
        r = self.random
        if kind == "menu":
            return self.wrapped(self.links(r.randint(3, 9)), ["nav", "div", "ul", "header"], ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb"])
        if kind == "header":
            return self.wrapped(f"<p>{self.words(1, 5)}</p><a href='/'>{self.words(1, 2)}</a>", ["header", "div"], ["header", "masthead", "branding", "topbar", "logo"])
        if kind == "footer":
            text = self.one("&copy; ", "Copyright ", "") + self.words(3, 25)
            return self.wrapped(self.one(text, f"<p>{text}</p>", text + self.links(3)), ["footer", "div"], ["footer", "bottom", "colophon", "copyright", "legal"])
        if kind == "sidebar":
            inner = f"<h3>{self.words(1, 4)}</h3>" + self.one(self.links(r.randint(2, 7)), f"<p>{self.paragraph()}</p>")
            return self.wrapped(inner, ["aside", "div", "section"], ["sidebar", "related", "widget", "recommended", "popular", "rail", "trending", "author-bio"])
        if kind == "notice":
            text = self.one("We use cookies. ", "Please accept cookies to go on. ", "") + self.words(4, 25)
            return self.wrapped(self.one(text, f"<p>{text}</p>"), ["div", "aside", "dialog", "section"], ["cookie", "consent", "notice", "banner", "gdpr", "alert", "popup", "modal", "paywall"])
        if kind == "advert":
            return self.wrapped(self.one(self.words(3, 25), f"<p>{self.paragraph()}</p>", f'<a href="/x">{self.words(2, 9)}</a>'), ["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adsense", "commercial"])
        if kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name='q'><p>{self.words(3, 20)}</p>"
            return self.one(f"<form>{inner}</form>", self.wrapped(f"<form>{inner}</form>", ["div", "section"], ["newsletter", "subscribe", "signup", "search", "login", "contact"]))
        if kind == "share":
            return self.wrapped(self.one(self.links(3), f"<p>{self.words(1, 6)}</p>"), ["div", "ul", "section"], ["share", "social", "tags", "byline", "meta", "toolbar", "pagination"])
        items = [f'<{self.one("li", "div")} class="comment"><p>{self.one("", self.words(1, 2) + ": ")}{self.paragraph()}</p></div>' for _ in range(r.randint(1, 5))]
        heading = self.one("", f"<h3>{self.one('Comments', 'Kommentare', 'Commentaires', 'Comentarios')}</h3>", f"<h2>{self.words(1, 3)}</h2>")
        return self.wrapped(heading + "".join(items), ["section", "div", "ol", "ul"], ["comments", "comment-list", "responses", "discussion", "replies", "disqus", "reader-comments"])

    def main(self) -> list[str]:
        r = self.random
        parts = [f"<{h}>{self.words(2, 12)}</{h}>"] if (h := self.one("h1", "h1", "h2", "")) else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.75:
                parts.append(f"<p>{self.paragraph()}" + self.one("</p>", "</p>", ""))
            elif kind < 0.82:
                parts.append(f"<h2>{self.words(1, 8)}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote>{self.paragraph()}</blockquote>")
            else:
                parts.append(f"<div>{self.paragraph()}</div>")
        return parts

    def page(self) -> tuple[list[list[str]], list[int]]:
        """Features and labels of one page; blocks of the article carry a mark that is taken off again."""
        r = self.random
        sign = ""
        inner = [re.sub(r"(<(?:p|h1|h2|li|blockquote|div)>)", rf"\1{sign}", p) for p in self.main()]
        for kind in ("advert", "share", "comments", "form", "sidebar"):
            if r.random() < 0.4:
                inner.insert(r.randint(0, len(inner)) if kind != "comments" else len(inner), self.other(kind))
        article = "".join(inner)
        tag = self.one("article", "article", "main", "div", "div", "section", "td")
        name = self.one("content", "post", "entry", "article", "story", "body", "post-content", "main", "text", "page", "")
        article = f"<{tag}{f' class=\"{name}\"' if name and (tag != 'article' or r.random() < 0.3) else ''}>{article}</{tag}>"
        before = [self.other(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if r.random() < 0.4]
        after = [self.other(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice") if r.random() < 0.35]
        if r.random() < 0.9:
            after.append(self.other("footer"))
        body = "".join([*before, article, *after])
        if r.random() < 0.3:
            body = f'<div class="{self.one("wrapper", "container", "page", "layout")}">{body}</div>'
        found = blocks(f"<html><body>{body}</body></html>")
        labels = [int(sign in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(sign, "").strip() or "-"
        return features(found), labels


def labelled(sample: list[str], built: int = BUILT_PAGES) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pages: those of the sample that mark their article, and built ones."""
    out, long, short = [], [], []
    for page in sample:
        found = blocks(page)
        for b in found:
            (long if len(b.text) > 80 and not b.linked else short).append(b.text)
        labels = marked(found)
        if found and labels is not None:
            out.append((features(found), labels))
    build = Builder(long[:5000], short[:5000], 11)
    return out + [page for page in (build.page() for _ in range(built)) if page[0]]


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Field:
    order = [F.xxhash64(F.col("page_id").cast("string")), F.col("page_id")]
    chosen = pages.where("html is not null").select("page_id", "html").orderBy(*order).limit(sample_pages)
    chosen = staged(chosen, "sample-pages").withColumn("_size", F.octet_length("html"))
    total = F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # A row for each of the few sampled pages.
    kept = chosen.withColumn("_total", total).where(F.col("_total") <= SAMPLE_BYTES).orderBy("_total", *order)
    return train(labelled([r["html"] for r in kept.select("html").collect()]))


def extract(field: Field, page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, label in zip(found, field.labels(found)) if label)


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages(page_id, url, html)`."""
    field = field or fit(pages)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [extract(field, x.as_py() or "") for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
