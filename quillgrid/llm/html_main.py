"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is read into leaf blocks, the runs of text between block-level tags, each with the tags and class words around it. The field has two
states, main and other; a block's features are its ancestors' tags and class words, its own tag, and figures of its text (words, links, ends of
sentences). It is trained on labelled pages by gradient ascent of the conditional likelihood and decoded by Viterbi.

The labelled pages come from ``labelled_pages``: made pages in many layouts, whose main blocks are marked. Others may be given to ``train``.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page; the first ones hold no tags, so only their closing tag ends them.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "iframe", "textarea", "noscript", "template")}
_HIDDEN = frozenset("svg object select canvas".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
#: Different marks of the containers around a block, outer ones first.
_MARKS_AROUND = 256
#: Tags with unpaired quotes that a page may hold before quotes are no longer looked at: each costs a look at the rest of the page.
_BROKEN_TAGS = 16
_MARKS = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CONTAINERS = frozenset(
    "html head body main article section div header footer nav aside form fieldset ul ol dl table thead tbody tfoot tr blockquote figure "
    "details dialog menu center title button label".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre address hr summary legend option".split())


@dataclass
class Block:
    """A leaf block: white space as single blanks, references decoded."""

    text: str
    tag: str
    around: tuple[str, ...]
    linked: int


def tokens(page: str) -> Iterator[tuple[str, bool, str]]:
    """Texts as ``("", False, text)`` and tags as ``(name, closing, attributes)``, in one pass. What is not a tag is text.

    An attribute's quotes may hold ``>``; a tag whose quotes don't pair ends at its first ``>``. Comments, declarations, and scripts and the
    like with all they hold are left out; without an end they take the rest of the page.
    """
    pos = start = broken = 0
    n = len(page)
    while True:
        at = page.find("<", pos)
        close = page.find(">", at) if at >= 0 else -1
        if close < 0 and not (at >= 0 and page.startswith("<!--", at)):
            break
        if page.startswith("<!--", at):
            if at > start:
                yield "", False, page[start:at]
            end = page.find("-->", at + 4)
            pos = start = n if end < 0 else end + 3
            continue
        if page[at + 1] in "!?":
            if at > start:
                yield "", False, page[start:at]
            pos = start = close + 1
            continue
        name = _NAME.match(page, at + 1)
        if name is None:
            pos = at + 1
            continue
        if at > start:
            yield "", False, page[start:at]
        end = close + 1
        if broken < _BROKEN_TAGS:
            whole = _ATTRIBUTES.match(page, name.end())
            if whole is None:
                broken += 1
            else:
                end = whole.end()
        kind, closing, attributes = name[2].lower(), bool(name[1]), page[name.end():end - 1]
        pos = start = end
        if kind in _RAW and not closing:
            found = _RAW[kind].search(page, end)
            pos = start = n if found is None else found.end()
        else:
            yield kind, closing, attributes
    if start < n:
        yield "", False, page[start:]


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Unclosed tags end with their container; what is not a tag is text.

    Hidden elements (drawings, embedded objects, choices) end with their closing tag or their container; a self-closed one is empty.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    around: tuple[str, ...] = ()
    buf: list[str] = []
    tag, own, linked, in_link = "", (), 0, 0
    hidden: list[tuple[str, int]] = []

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                out.append(Block(text, tag, around + own, linked))
            buf.clear()
        linked = 0

    for name, closing, rest in tokens(page):
        if not name:
            if not hidden:
                buf.append(rest)
                if in_link:
                    linked += len(rest)
        elif name in _HIDDEN:
            if not closing:
                if not (name == "svg" and rest.endswith("/")):
                    hidden.append((name, len(stack)))
            else:
                for i in range(len(hidden) - 1, -1, -1):
                    if hidden[i][0] == name:
                        del hidden[i:]
                        break
        elif name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            buf.append(" ")
        elif name in _CONTAINERS:
            flush()
            tag, own = "", ()
            if not closing:
                stack.append((name, around))
                new = [m for m in dict.fromkeys((name, *_marks(rest))) if m not in around]
                if new and len(around) < _MARKS_AROUND:
                    around = around + tuple(new)
                in_link = 0
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        around = stack[i][1]
                        del stack[i:]
                        while hidden and hidden[-1][1] > i:
                            hidden.pop()
                        break
        elif name in _LEAVES:
            flush()
            tag, own = ("", ()) if closing else (name, _marks(rest))
    flush()
    return out


def _marks(attributes: str | None) -> tuple[str, ...]:
    """Words of class, id and role."""
    if not attributes or "=" not in attributes:
        return ()
    return tuple("." + w for _, a, b, c in _MARKS.findall(attributes) for w in _WORD.findall((a or b or c).lower()))


def features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    out = [*set(block.around), "<" + block.tag, f"words{min(7, words.bit_length())}", f"links{0 if share < 0.2 else 1 if share < 0.7 else 2}"]
    if text[-1] in ".!?…\"”":
        out.append("ends")
    if "©" in text:
        out.append("copyright")
    return out


@dataclass
class Field:
    """Weights: ``index`` of features, ``emit`` by feature and state, ``move`` between states (0 other, 1 main)."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest states (Viterbi)."""
        if not page:
            return []
        index, weight = self.index, (self.emit[:, 1] - self.emit[:, 0]).tolist()
        (a, b), (c, d) = self.move.tolist()
        bias = weight[0]
        score0, score1, back = 0.0, 0.0, []
        for i, block in enumerate(page):
            s = bias + sum(weight[index[f]] for f in features(block) if f in index)
            if i == 0:
                score0, score1 = 0.0, s
                continue
            back.append((0 if score0 + a >= score1 + c else 1, 0 if score0 + b >= score1 + d else 1))
            score0, score1 = max(score0 + a, score1 + c), max(score0 + b, score1 + d) + s
        state = int(score1 > score0)
        states = [state]
        for pair in reversed(back):
            state = pair[state]
            states.append(state)
        return states[::-1]


def train(pages: Iterable[tuple[list[Block], list[int]]], rounds: int = 300, l2: float = 0.02, rate: float = 0.3) -> Field:
    """Maximise the conditional likelihood of the labelled pages by AdaGrad; all pages go through the recursions side by side."""
    pages = [(b, y) for b, y in pages if b]
    index = {"(bias)": 0}
    rows = [[[0] + sorted({index.setdefault(f, len(index)) for f in features(x)}) for x in b] for b, _ in pages]
    n, steps, size = len(pages), max(len(b) for b, _ in pages), len(index)
    x = np.zeros((n, steps, size))
    y, mask = np.zeros((n, steps), int), np.zeros((n, steps))
    for i, (page, labels) in enumerate(zip(rows, (y for _, y in pages))):
        for t, (row, label) in enumerate(zip(page, labels)):
            x[i, t, row] = 1
            y[i, t], mask[i, t] = label, 1
    emit, move = np.zeros((size, 2)), np.zeros((2, 2))
    past_e, past_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    both = mask[:, 1:] * mask[:, :-1]
    gold = np.array([[((y[:, :-1] == p) & (y[:, 1:] == q) & (both > 0)).sum() for q in (0, 1)] for p in (0, 1)], float)
    for _ in range(rounds):
        score = x @ emit
        score = np.exp(score - score.max(-1, keepdims=True))
        jump = np.exp(move)
        a = np.zeros((n, steps, 2))
        a[:, 0] = score[:, 0] / score[:, 0].sum(-1, keepdims=True)
        for t in range(1, steps):
            v = (a[:, t - 1] @ jump) * score[:, t]
            v = np.where(mask[:, t, None] > 0, v, a[:, t - 1])
            a[:, t] = v / v.sum(-1, keepdims=True)
        b = np.ones((n, steps, 2))
        expected = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            right = score[:, t] * b[:, t]
            pair = a[:, t - 1, :, None] * jump * right[:, None, :] * mask[:, t, None, None]
            total = pair.sum((1, 2), keepdims=True)
            expected += (pair / np.where(total > 0, total, 1)).sum(0)
            back = right @ jump.T
            b[:, t - 1] = np.where(mask[:, t, None] > 0, back / back.sum(-1, keepdims=True), b[:, t])
        p = a * b
        p = p / p.sum(-1, keepdims=True)
        error = (np.eye(2)[y] - p) * mask[..., None]
        grad_e = np.einsum("ntf,nts->fs", x, error) / n - l2 * emit / 10
        grad_m = (gold - expected) / n - l2 * move / 10
        past_e += grad_e ** 2
        past_m += grad_m ** 2
        emit += rate * grad_e / np.sqrt(past_e)
        move += rate * grad_m / np.sqrt(past_m)
    return Field(index, emit, move)


#: Marks the main blocks of made pages.
_MAIN = "\u0001"
_MENUS = ("nav", 'div class="menu"', 'ul class="nav-links"', 'div id="navigation"', 'div role="navigation"', 'div class="breadcrumb"', 'div class="topbar menu"')
_HEADERS = ("header", 'div class="header"', 'div id="masthead"', 'div class="site-header"')
_FOOTERS = ("footer", 'div class="footer"', 'div id="site-footer"', 'div class="copyright"')
_SIDES = ("aside", 'div class="sidebar"', 'div id="side"', 'div class="widget related"', 'section class="related"', 'div class="recommended"')
_ADVERTS = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div id="banner-ad"')
_NOTICES = ('div class="cookie"', 'div class="notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="alert notice"', 'div class="newsletter"', 'div class="popup modal"')
_COMMENTS = ('section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="comment-thread"', 'ul class="comment"', 'div class="disqus comments"')
_MAINS = ("article", "main", 'div class="content"', 'div id="main"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"',
          'div id="story"', 'section class="article"', 'main class="page"', 'article class="post"', 'div itemprop="articleBody"', 'div class="text body"')


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Made pages in many layouts, read into blocks, with 1 for the main ones.

    Containers of the kinds a page has (menu, header, footer, sidebar, advert, notice, form, comments) stand around and inside the
    main text, in tags or in class words; lengths of main and other blocks overlap, so that structure decides.
    """
    rng = random.Random(seed)

    def sentence(lo: int, hi: int) -> str:
        out = " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi)))
        return out.capitalize() + rng.choice(("", ".", ".", "."))

    def prose() -> str:
        return " ".join(sentence(2, 14) for _ in range(rng.choice((1, 1, 2, 4, 7))))

    def wrap(kind: str, inner: str) -> str:
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    def links(item: str = "li") -> str:
        each = [f'<{item}><a href="/x">{sentence(1, 2)}</a></{item}>' for _ in range(rng.randint(1, 7))]
        return wrap("ul", "".join(each)) if item == "li" else "".join(each)

    def other(kinds: tuple[str, ...]) -> str:
        body = rng.choice((links, lambda: links("p"), lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}</p><p>{prose()}</p>", prose, lambda: f"<h3>{sentence(1, 3)}</h3>{links()}",
                           lambda: f"<h2>{sentence(1, 3)}</h2><p>{prose()}</p>", lambda: f"<ol><li><b>{sentence(1, 1)}</b><p>{prose()}</p></li><li>{prose()}</li></ol>"))()
        return wrap(rng.choice(kinds), body)

    def foot() -> str:
        return wrap(rng.choice(_FOOTERS), rng.choice((f"&copy; {sentence(1, 3)} &middot; {prose()}", f"<p>&copy; 2020 {sentence(1, 4)}</p>{links()}", links(), f"<p>{prose()}</p>")))

    def form() -> str:
        asked = rng.choice((prose, lambda: sentence(1, 3)))()
        return rng.choice((
            f'<form action="/go"><label>{sentence(1, 3)}</label><input name="q"><p>{asked}</p><button>{sentence(1, 2)}</button></form>',
            f"<form><p>{asked}</p></form>", f"<form><div><p>{asked}</p><input></div></form>"))

    def main_part() -> str:
        p = rng.random()
        if p < 0.72:
            return f"<p>{_MAIN}{prose()}</p>"
        if p < 0.80:
            return f"<h2>{_MAIN}{sentence(1, 6)}</h2>"
        if p < 0.86:
            return "<ul>" + "".join(f"<li>{_MAIN}{prose()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if p < 0.90:
            return f"<blockquote><p>{_MAIN}{prose()}</p></blockquote>"
        if p < 0.93:
            return f'<p><a href="/y">{_MAIN}{sentence(1, 6)}</a></p>'
        if p < 0.96:
            return f"<table><tr><td>{_MAIN}{sentence(1, 3)}</td><td>{_MAIN}{sentence(1, 3)}</td></tr></table>"
        return f"<pre>{_MAIN}{prose()}</pre>"

    out = []
    for _ in range(n):
        parts = [f"<h1>{_MAIN}{sentence(1, 8)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 2, 4, 8))):
            parts.append(main_part())
            if rng.random() < 0.2:
                parts.append(rng.choice((lambda: other(_ADVERTS), lambda: other(_SIDES), lambda: other(_NOTICES), form))())
            if rng.random() < 0.06:
                parts.append(form())
        if rng.random() < 0.2:
            parts.append(other(_COMMENTS))
        kind = rng.random()
        if kind < 0.1:  # nothing tells the main part but what is around it
            main = "".join(parts)
        elif kind < 0.25:
            unknown = "".join(rng.choice("bcdfgkmpwxz") for _ in range(4))
            main = wrap(rng.choice(("div", f'div class="{unknown}"', f'section id="{unknown}"')), "".join(parts))
        else:
            main = wrap(rng.choice(_MAINS) if kind < 0.7 else "article", "".join(parts))
        before = [f() for f in (lambda: other(_MENUS), lambda: other(_HEADERS), lambda: other(_ADVERTS), lambda: other(_NOTICES), form, lambda: other(_SIDES)) if rng.random() < 0.5]
        after = [f() for f in (lambda: other(_COMMENTS), lambda: other(_SIDES), form, lambda: other(_ADVERTS), lambda: other(_NOTICES)) if rng.random() < 0.4]
        rng.shuffle(before)
        rng.shuffle(after)
        middle = "".join(before) + main + "".join(after)
        if rng.random() < 0.3:
            middle = wrap(rng.choice(('div class="wrap"', 'div id="page"', 'div class="container"')), middle)
        page = blocks(f"<html><head><title>{sentence(1, 6)}</title></head><body>{middle}{foot() if rng.random() < 0.8 else ''}</body></html>")
        labels = [int(_MAIN in b.text) for b in page]
        for b in page:
            b.text = b.text.replace(_MAIN, "")
        out.append(([b for b in page if b.text], [y for b, y in zip(page, labels) if b.text]))
    return out


def main_text(page: str, field: Field) -> str:
    """The main blocks, one a line."""
    found = blocks(page)
    return "\n".join(b.text for b, s in zip(found, field.decode(found)) if s)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """All columns but ``html``, with ``text`` and ``n_chars`` (replaced if there).

    Null html counts as empty and gives an empty text, as does a page without main blocks. Every page is read whole; repeated rows are
    read each.
    """
    field = field or train(labelled_pages())
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", shared.value) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in names)
    return pages.select(F.col("html").cast("string"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{schema}text string, n_chars long")
