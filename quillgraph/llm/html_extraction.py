"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A lenient scanner cuts a page into leaf blocks: runs of text between block-level tags, each with the tags,
classes and ids of its ancestors, without scripts, styles and comments. The field labels each block as
main text or not, from ancestor-tag and text features and the neighbouring label; Viterbi finds the best
labelling. It is trained, by its log-likelihood, on labelled pages that a seeded generator composes here
from many layouts of articles, menus, headers, footers, sidebars, notices, adverts, forms and comments, with
and without telling tags and classes.

Cases: null or empty html gives an empty text of 0 characters; text outside any tag is a block like any
other; unclosed tags are closed by their parents; malformed tags are text. A page of any length or depth takes
time in proportion to its length: features come from the ANCESTORS nearest block-level ancestors of a block,
its text is whole. Repeated rows are extracted alike. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html as html_module
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.common import map_arrow, own, texts

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: The end of a self-closing tag's attributes; the slash of an unquoted value is none.
CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
#: Characters of scripts that put no spaces between words, of which two stand for a word; ends of sentences in any script.
UNSPACED = re.compile(r"[\u0e00-\u0edf\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
STOPS = ".!?。．｡！？؟۔।॥"
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Fixed values of HTML: elements whose content is never text of the page; void elements; inline elements.
RAW = frozenset("script style noscript template iframe head title textarea select option button annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mfenced msub msup msubsup munder mover munderover semantics svg g text tspan path canvas object audio video map picture".split())
#: Ancestors, and names of one element, that features are made of, at most.
ANCESTORS, NAMES = 32, 16
#: A start tag of the key closes an open element of the values, up to a container.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BLOCK_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDERS = frozenset("html body div section article main aside nav header footer ul ol table td th form blockquote".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # features of the ancestors
    tag: str
    linked: int  # characters inside links


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of the class, id and role attributes, lower-cased."""
    out = []
    for _, value in NAMED.findall(attributes):
        out += [t.lower() for t in TOKEN.findall(value)]
    return tuple(out[:NAMES])


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    outer: list[tuple[str, tuple[str, ...]]] = []  # of the stack, what is not inline
    open_: Counter[str] = Counter()  # of the stack's tags
    endless: set[str] = set()  # raw elements that no end tag follows any more
    parts: list[tuple[str, bool]] = []
    at, links = 0, 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p) for p, link in parts if link)
                path = tuple(dict.fromkeys(f for tag, names in outer[-ANCESTORS:] for f in (f"t={tag}", *(f"c={n}" for n in names))))
                out.append(Block(text, path, outer[-1][0] if outer else "", linked))
            parts.clear()

    def add(piece: str) -> None:
        if piece:
            parts.append((html_module.unescape(piece) if "&" in piece else piece, links > 0))

    def pop(tag: str) -> None:
        nonlocal links
        while stack:
            top = stack.pop()[0]
            open_[top] -= 1
            links -= top == "a"
            if top not in INLINE:
                outer.pop()
            if top == tag:
                break

    search, n = TAG.search, len(page)
    while at < n:
        found = search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag not in INLINE:
                flush()
            if open_[tag]:
                pop(tag)
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in RAW:
            if tag not in INLINE and tag not in ("select", "button", "option"):
                flush()
            if not CLOSED.search(found[3]):
                end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if end is not None:
                    at = end.end()
                    continue
                endless.add(tag)
                if tag in ("script", "style", "title", "textarea"):
                    at = n
            continue
        if tag not in INLINE:
            flush()
            if tag in VOID:
                continue
            if tag in BLOCK_CLOSES_P and open_["p"]:
                inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in HOLDERS or stack[i][0] == "p")
                if stack[inner][0] == "p":
                    pop("p")
            if tag in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[tag]:
                        pop(stack[i][0])
                        break
                    if stack[i][0] in HOLDERS:
                        break
        elif tag in VOID:
            continue
        if not CLOSED.search(found[3]):
            stack.append((tag, names_of(found[3]) if found[3] else ()))
            if tag not in INLINE:
                outer.append(stack[-1])
            open_[tag] += 1
            links += tag == "a"
    flush()
    return out


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Names of the binary features that hold for each block."""
    out, n = [], len(blocks)
    longest = max((len(b.text) for b in blocks), default=1)
    for i, b in enumerate(blocks):
        unspaced = 0 if b.text.isascii() else sum(map(len, UNSPACED.findall(b.text)))
        words = b.text.count(" ") + 1 + unspaced // 2
        f = ["bias", f"own={b.tag}", *b.path]
        f.append(f"words={min(9, int(math.log2(words + 1)))}")
        f.append(f"share={min(5, 6 * len(b.text) // (longest + 1))}")
        f.append(f"links={min(4, 5 * b.linked // (len(b.text) + 1))}")
        stops = sum(map(b.text.count, ".!?" if b.text.isascii() else STOPS))
        f.append("stops=" + ("0" if not stops else "few" if stops < 3 else "many"))
        f.append(f"place={4 * i // n}")
        if b.text[0] in "©|»«•" or b.text.startswith("Copyright"):
            f.append("mark")
        if len(b.path) < 3:
            f.append("shallow")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights for the label 1 (against 0) of each feature, and for each pair of neighbouring labels."""

    weight: dict[str, float]
    pair: list[list[float]]

    def emissions(self, rows: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def viterbi(self, emissions: list[float]) -> list[int]:
        if not emissions:
            return []
        (p00, p01), (p10, p11) = self.pair
        zero, one, back = 0.0, emissions[0], []
        for e in emissions[1:]:
            a, b, c, d = zero + p00, one + p10, zero + p01, one + p11
            back.append((a < b, c < d))
            zero, one = max(a, b), max(c, d) + e
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def marginals(self, emissions: list[float]) -> tuple[list[float], list[list[float]]]:
        """Chance of label 1 for each block; expected numbers of each pair of labels: forward and backward sums."""
        n = len(emissions)
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        pair = self.pair
        forward = [(0.0, emissions[0])]
        for e in emissions[1:]:
            z, o = forward[-1]
            forward.append((add(z + pair[0][0], o + pair[1][0]), add(z + pair[0][1], o + pair[1][1]) + e))
        backward = [(0.0, 0.0)] * n
        for i in range(n - 2, -1, -1):
            z, o = backward[i + 1]
            o += emissions[i + 1]
            backward[i] = (add(pair[0][0] + z, pair[0][1] + o), add(pair[1][0] + z, pair[1][1] + o))
        total = add(*forward[-1])
        ones = [math.exp(f[1] + b[1] - total) for f, b in zip(forward, backward, strict=True)]
        pairs = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n - 1):
            for s in (0, 1):
                for t in (0, 1):
                    pairs[s][t] += math.exp(forward[i][s] + pair[s][t] + (emissions[i + 1] if t else 0) + backward[i + 1][t] - total)
        return ones, pairs


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, pace: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    """Ascent on the log-likelihood with paces that shrink by weight (AdaGrad), a page at a time."""
    field, seen = Field({}, [[0.0, 0.0], [0.0, 0.0]]), Counter()
    order, shuffle = list(range(len(pages))), random.Random(seed)
    pair_seen = [[1e-6] * 2, [1e-6] * 2]
    for _ in range(epochs):
        shuffle.shuffle(order)
        for k in order:
            rows, labels = pages[k]
            if not rows:
                continue
            ones, pairs = field.marginals(field.emissions(rows))
            grad: Counter = Counter()
            for row, label, one in zip(rows, labels, ones, strict=True):
                for f in row:
                    grad[f] += label - one
            for f, g in grad.items():
                g -= decay * field.weight.get(f, 0.0)
                seen[f] += g * g
                field.weight[f] = field.weight.get(f, 0.0) + pace * g / math.sqrt(seen[f] + 1e-8)
            for a, b in zip(labels, labels[1:], strict=False):
                pairs[a][b] -= 1
            for s in (0, 1):
                for t in (0, 1):
                    pair_seen[s][t] += pairs[s][t] ** 2
                    field.pair[s][t] -= pace * pairs[s][t] / math.sqrt(pair_seen[s][t])
    return field


#: Class and id words of the parts of a page, for the composed training pages.
PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc tabs",
    "header": "header masthead topbar banner logo branding site hero",
    "footer": "footer copyright legal colophon bottom",
    "sidebar": "sidebar side rail widget related recommended trending popular more aside",
    "notice": "cookie consent notice gdpr alert popup modal overlay subscribe newsletter paywall message",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adslot",
    "form": "form search login signup contact newsletter",
    "comments": "comments comment discussion replies reply respond thread disqus feedback reviews responses talkback guestbook",
    "share": "share social sharing tags meta pagination pager",
}
MAIN = "article content post entry story body main text page single blog prose"
SYLLABLES = "ba ne ti lo mu ra se ko vi da pe lu en or the of an is st re qu ch ment tion".split()


def composed_pages(n: int, seed: int = 17) -> list[tuple[str, list[int]]]:
    """Pages with the label of each of their leaf blocks."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(low: int = 3, high: int = 22) -> str:
        out = [word() for _ in range(r.randint(low, high))]
        return out[0].capitalize() + " " + " ".join(out[1:]) + r.choice([".", ".", ".", "!", "?", ""])

    def prose(most: int = 6) -> str:
        return " ".join(sentence() for _ in range(r.randint(1, most)))

    def inline(text: str) -> str:
        if r.random() < 0.25:
            words = text.split(" ")
            k = r.randrange(len(words))
            tag = r.choice(["b", "i", "em", "strong", "a href='/x'", "span", "code"])
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
            text = " ".join(words)
        return text

    def named(kind: str) -> str:
        words = PARTS[kind].split() if kind in PARTS else kind.split()
        value = r.choice(["{}", "{}", "{}-{}", "site-{}", "{}_box", "main-{}", "{} clearfix", "js-{}", "{}Wrapper"]).format(r.choice(words), r.choice(words))
        return f' {r.choice(["class", "class", "id"])}="{value}"'

    def links(wrap: str = "ul") -> tuple[str, int]:
        n_links = r.randint(2, 9)
        items = [f'<li><a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 3)))}</a>' + r.choice(["</li>", "</li>", ""]) for _ in range(n_links)]
        return f"<{wrap}>{''.join(items)}</{wrap}>", n_links

    def junk(kind: str) -> tuple[str, list[int]]:
        plain = r.random()
        if kind == "menu":
            body, k = links()
            if r.random() < 0.25:  # a line of links, or one
                body, k = " ".join(f"<a href='/{word()}'>{word()}</a>" for _ in range(r.randint(1, 6))), 1
            tag = r.choice(["nav", "nav", "div", "header"])
            return f"<{tag}{named('menu') if tag == 'div' or plain < 0.3 else ''}>{body}</{tag}>", [0] * k
        if kind == "header":
            tag = r.choice(["header", "div"])
            return f"<{tag}{named('header') if tag == 'div' else ''}><{(h := r.choice(['h1', 'div', 'p', 'span']))}>{sentence(1, 6)}</{h}></{tag}>", [0]
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            text = r.choice([f"&copy; {sentence(1, 6)}", f"Copyright 20{r.randint(10, 25)} {sentence(2, 8)}", sentence()])
            body, k = links() if r.random() < 0.3 else ("", 0)
            return f"<{tag}{named('footer') if tag == 'div' else ''}>{body}{text}</{tag}>", [0] * (k + 1)
        if kind == "comments":
            tag, k = r.choice(["div", "section", "ol", "aside"]), r.randint(1, 5)
            item = "li" if tag == "ol" else r.choice(["div", "p", "article"])
            name = r.choice(["", ' class="comment"'])
            heading = f"<h3>{sentence(1, 3)}</h3>" if r.random() < 0.6 and tag != "ol" else ""
            return f"<{tag}{named('comments')}>{heading}{''.join(f'<{item}{name}>{prose(3)}</{item}>' for _ in range(k))}</{tag}>", [0] * (k + bool(heading))
        if kind == "form":
            return f"<form{named('form') if plain < 0.5 else ''}><label>{sentence(1, 4)}</label><input name=q><p>{sentence(2, 9)}</p><button>{word()}</button></form>", [0, 0]
        if kind == "sidebar":
            tag = r.choice(["aside", "aside", "div", "section"])
            body, k = links()
            text = f"<h3>{sentence(1, 3)}</h3>" if r.random() < 0.6 else ""
            more = f"<p>{prose(2)}</p>" if r.random() < 0.5 else ""
            return f"<{tag}{named('sidebar') if tag != 'aside' or plain < 0.3 else ''}>{text}{body}{more}</{tag}>", [0] * (k + bool(text) + bool(more))
        tag = r.choice(["div", "div", "section", "aside", "p"])
        inner = prose(2)
        if tag != "p" and r.random() < 0.4:
            inner = f"<p>{inner}</p>"
        return f"<{tag}{named(kind)}>{inner}</{tag}>", [0]

    def article() -> tuple[str, list[int]]:
        out, labels = [], []
        paragraph = "div" if r.random() < 0.15 else "p"
        if r.random() < 0.8:
            out.append(f"<h1>{sentence(2, 12)}</h1>")
            labels.append(1)
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.72:
                text = inline(prose(r.choice([1, 3, 8])))
                out.append(f"<{paragraph}>{text}" + ("" if paragraph == "p" and r.random() < 0.15 else f"</{paragraph}>"))
                labels.append(1)
            elif kind < 0.8:
                h = r.choice(["h2", "h3", "h4"])
                out.append(f"<{h}>{sentence(1, 7)}</{h}>")
                labels.append(1)
            elif kind < 0.88:
                k = r.randint(1, 5)
                out.append(f"<{(u := r.choice(['ul', 'ol']))}>{''.join(f'<li>{inline(sentence())}</li>' for _ in range(k))}</{u}>")
                labels += [1] * k
            elif kind < 0.92:
                out.append(f"<{(q := r.choice(['blockquote', 'pre', 'figcaption']))}>{sentence()}</{q}>")
                labels.append(1)
            elif kind < 0.95:
                out.append(f"<table><tr><th>{word()}</th><td>{sentence(1, 5)}</td></tr></table>")
                labels += [1, 1]
            else:
                body, zero = junk(r.choice(["advert", "share", "notice", "advert", "form", "sidebar"]))
                out.append(body)
                labels += zero
        return "".join(out), labels

    pages = []
    for _ in range(n):
        if r.random() < 0.08:  # nothing but a text
            text = prose(2)
            pages.append((r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<html><body>{}</body></html>", "<body><p>{}</p></body>"]).format(text), [1]))
            continue
        before = [junk(k) for k in ("menu", "header", "notice", "advert", "form", "sidebar") if r.random() < 0.45]
        after = [junk(k) for k in ("sidebar", "comments", "advert", "share", "notice", "menu") if r.random() < 0.4]
        if r.random() < 0.8:
            after.append(junk("footer"))
        r.shuffle(before)
        text, labels = article()
        kind = r.random()
        if kind < 0.5:
            text = f"<article{named(MAIN) if r.random() < 0.3 else ''}>{text}</article>"
        elif kind < 0.65:
            text = f"<main>{text}</main>"
        elif kind < 0.92:
            text = f"<div{named(MAIN)}>{text}</div>"
        elif kind > 0.95:
            text = f"<section>{text}</section>"
        if r.random() < 0.3:
            text = f"<main>{text}</main>" if "<main" not in text else text
        if r.random() < 0.2:
            text = f'<div class="{r.choice(["wrapper", "container", "page", "layout"])}">{text}</div>'
        head = f"<head><meta charset=utf-8><title>{sentence()}</title><style>main>p{{line-height:1.5}}</style><script>if (1<2) document.title+='<b>';</script></head>"
        body = "".join(b for b, _ in before) + "<!-- <p>left out</p> -->" * (r.random() < 0.3) + text + "".join(a for a, _ in after)
        end = "</body></html>" if r.random() < 0.9 else ""
        pages.append((f"<!DOCTYPE html><html>{head}<body>{body}{end}", [x for _, ls in before for x in ls] + labels + [x for _, ls in after for x in ls]))
    return pages


@lru_cache(maxsize=2)
def trained_field(n: int = 600, seed: int = 17) -> Field:
    rows = []
    for page, labels in composed_pages(n, seed):
        blocks = blocks_of(page)
        if len(blocks) == len(labels):  # else the page's label list does not fit what a scanner can see
            rows.append((features_of(blocks), labels))
    return train(rows)


def main_text(page: str, field: Field) -> str:
    blocks = blocks_of(page)
    labels = field.viterbi(field.emissions(features_of(blocks)))
    return " ".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(trained_field())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(p, shared.value) for p in texts(batch.column("html"))]
        return pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())})

    source = pages.select(own(pages, "page_id").cast("long").alias("page_id"), own(pages, "url").cast("string").alias("url"), own(pages, "html").cast("string").alias("html"))
    return map_arrow(source, run, "page_id long, url string, text string, n_chars long")
