"""HTML extraction: a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks, runs of inline text without a block-level tag in between. Each block has features of its
ancestor tags, of the class, id and role words on them, and of its text. A two-label chain (main text or not) over the
blocks is trained by stochastic gradients on labelled pages, with forward-backward marginals, and decoded by Viterbi.

``labelled_pages`` makes the training pages from templates with known labels: menus, headers, footers, sidebars, notices,
adverts, forms, related links and reader comments around and inside articles of very different lengths, with unclosed tags.

Edge cases: null and empty html, and pages without main text, give an empty text; broken markup never fails, as unknown
or unmatched tags are skipped; very long pages are read whole in one pass, whatever their nesting; repeated pages and ids
are treated alike; an empty table stays empty; extra columns pass through, but one named ``text`` is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>"'<]*(?:[^>"']|"[^"]*"|'[^']*')*>?|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>\"'<]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
#: Elements of HTML by their role in the block structure.
RAW = set("script style title textarea".split())
#: Dropped up to their end tag; without one only the tag goes.
UNSEEN = set("template iframe select".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option label".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
WALLS = set("table ul ol dl div article section aside nav main body form blockquote".split())


@dataclass(frozen=True)
class Place:
    """What stands above a block: innermost block-level tag, all tags, all attribute words. Equal sets are shared."""

    tag: str = ""
    inside: str = "none"
    tags: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()

    def down(self, tag: str, words: list[str]) -> Place:
        tags = self.tags if tag in self.tags else self.tags | {tag}
        return Place(tag, tag if tag in BLOCK else self.inside, tags, self.words if self.words.issuperset(words) else self.words.union(words))


@dataclass
class Block:
    text: str
    place: Place
    linked: int


class Open:
    """The open tags, with their numbers in all and above the innermost wall, so a tag that is not there costs no search."""

    def __init__(self) -> None:
        self.stack: list[Place] = []
        self.all: Counter[str] = Counter()
        self.near: list[Counter[str]] = [Counter()]  # one more for each open wall

    def push(self, place: Place) -> None:
        self.stack.append(place)
        self.all[place.tag] += 1
        if place.tag in WALLS:
            self.near.append(Counter())
        else:
            self.near[-1][place.tag] += 1

    def close(self, tags: set[str], beyond_walls: bool) -> None:
        """Closes the innermost open tag of ``tags`` and all inside it; none beyond a wall unless said so."""
        known = self.all if beyond_walls else self.near[-1]
        if not any(known[t] for t in tags):
            return
        while self.stack:
            tag = self.stack.pop().tag
            self.all[tag] -= 1
            if tag in WALLS:
                self.near.pop()
            else:
                self.near[-1][tag] -= 1
            if tag in tags:
                return


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with the tags and the attribute words above them. One pass, linear in the page."""
    out: list[Block] = []
    tree = Open()
    parts: list[str] = []
    seen: Place | None = None
    linked, page, at = 0, page or "", 0
    ends: dict[str, re.Match | None] = {}

    def flush() -> None:
        nonlocal linked, seen
        text = " ".join("".join(parts).split())
        if text and seen:
            out.append(Block(text, seen, linked))
        parts.clear()
        linked, seen = 0, None

    def next_end(tag: str) -> re.Match | None:
        """The next end tag; looked for anew only behind the last one found."""
        if tag not in ends or (ends[tag] and ends[tag].start() < at):
            ends[tag] = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
        return ends[tag]

    while m := TOKEN.match(page, at):
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            text = entities.unescape(token)
            if seen is None and not text.isspace():
                seen = tree.stack[-1] if tree.stack else Place()
            if tree.stack and "a" in tree.stack[-1].tags:
                linked += len(text.split())
            parts.append(text)
            continue
        if not (name := NAME.match(token)):
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if tag in BLOCK:
                flush()
            tree.close({tag}, tag in BLOCK)
            continue
        if tag in RAW:
            end = next_end(tag)
            at = end.end() if end else len(page)
            continue
        if tag in UNSEEN:
            end = next_end(tag)
            again = re.compile(rf"<{tag}\b", re.I).search(page, at, end.start()) if end and tag != "template" else None
            if end and not again and not token.endswith("/>"):
                at = end.end()
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            flush()
            tree.close(CLOSES.get(tag, set()) | {"p", "h1", "h2", "h3", "h4", "h5", "h6"}, False)
        if tag in VOID or token.endswith("/>") and tag not in BLOCK:
            continue
        words = [w for _, v in ATTRIBUTE.findall(token) for w in re.split(r"[^a-z]+", v.lower()) if w]
        tree.push((tree.stack[-1] if tree.stack else Place()).down(tag, words))
    flush()
    return out


def features(bs: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for i, b in enumerate(bs):
        n = len(b.text.split())
        f = {f"own={b.place.inside}", "words=" + ("1-3" if n < 4 else "4-10" if n < 11 else "11-30" if n < 31 else "more"), "links=" + ("none" if not b.linked else "some" if 2 * b.linked < n else "most")}
        f |= {f"tag={t}" for t in b.place.tags} | {f"word={w}" for w in b.place.words}
        if "article" in b.place.tags or "main" in b.place.tags:
            f.add("in=article")
        if b.text[-1] in ".!?:;\"')»”":
            f.add("end=mark")
        if "©" in b.text or "copyright" in b.text.lower():
            f.add("has=copyright")
        if i == 0:
            f.add("first")
        out.append(sorted(f))
    return out


@dataclass
class Crf:
    names: dict[str, int]
    weights: np.ndarray  # feature by label
    moves: np.ndarray  # label by label

    def emissions(self, bs: list[Block]) -> np.ndarray:
        return np.stack([self.weights[[self.names[x] for x in f if x in self.names]].sum(axis=0) for f in features(bs)])

    def decode(self, bs: list[Block]) -> list[bool]:
        """Viterbi; ties go to main text."""
        if not bs:
            return []
        e, back = self.emissions(bs), []
        best = e[0]
        for row in e[1:]:
            total = best[:, None] + self.moves
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        y = [int(best[1] >= best[0])]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return [bool(v) for v in reversed(y)]


def train(pages: list[tuple[list[Block], list[bool]]], epochs: int = 12, rate: float = 0.5, l2: float = 1e-3, seed: int = 1) -> Crf:
    """Stochastic gradient ascent on the conditional likelihood, marginals by forward-backward."""
    names: dict[str, int] = {}
    data = []
    for bs, y in pages:
        if bs:
            data.append(([[names.setdefault(x, len(names)) for x in f] for f in features(bs)], np.array(y, int)))
    w, t = np.zeros((max(1, len(names)), 2)), np.zeros((2, 2))
    rng, step, steps = np.random.default_rng(seed), 0, epochs * len(data)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            f, y = data[i]
            e = np.stack([w[x].sum(axis=0) for x in f])
            n = len(f)
            a, b = np.zeros((n, 2)), np.zeros((n, 2))
            a[0] = e[0]
            for k in range(1, n):
                a[k] = e[k] + np.logaddexp(a[k - 1, 0] + t[0], a[k - 1, 1] + t[1])
            for k in range(n - 2, -1, -1):
                x = e[k + 1] + b[k + 1]
                b[k] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
            z = np.logaddexp(a[-1, 0], a[-1, 1])
            single = np.exp(a + b - z)
            now = rate / np.sqrt(n) * (1 - step / steps)
            single[np.arange(n), y] -= 1
            for k in range(n):
                w[f[k]] -= now * single[k]
            if n > 1:
                pair = np.exp(a[:-1, :, None] + t[None] + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0)
                np.add.at(pair, (y[:-1], y[1:]), -1)
                t -= now * pair
            w *= 1 - now * l2
            step += 1
    return Crf(names, w, t)


def labelled_pages(count: int = 400, seed: int = 4) -> list[tuple[list[Block], list[bool]]]:
    """Pages from templates; main text carries the mark ``\\x02`` until its blocks are labelled."""
    rng = np.random.default_rng(seed)
    stem = ["".join(rng.choice(list("aeioubdfglmnprstvw"), rng.integers(2, 9))) for _ in range(300)]
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p

    def say(lo: int, hi: int, mark: str = "") -> str:
        words = [str(w) for w in rng.choice(stem, rng.integers(lo, hi + 1))]
        return mark + " ".join(words).capitalize() + pick(".", ".", ".", "", "!", "?")

    def links(n: int) -> str:
        return "".join(pick("<li><a href='/x'>{}</a></li>", "<li><a href='/x'>{}</a>").format(say(1, 3)) for _ in range(n))

    def junk() -> str:
        kind = pick("ad", "ad", "aside", "notice", "form", "related", "share", "menu")
        if kind == "ad":
            return f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner ad")}">{say(1, 30)}</div>'
        if kind == "aside":
            return pick("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<aside class="widget">{}</aside>').format(pick("<h3>{}</h3><ul>{}</ul>", "<p>{}</p>{}").format(say(1, 4), links(rng.integers(0, 5))))
        if kind == "notice":
            return f'<div class="{pick("notice", "cookie notice", "cookie banner", "consent", "alert", "popup", "modal", "gdpr")}">{pick("<p>{}</p>", "{}").format(say(3, 30))}{pick("", "<button>Ok</button>")}</div>'
        if kind == "form":
            return f'<form{pick("", "", " action=/q", f' class="{pick("subscribe", "newsletter", "search", "login")}"')}>{pick("", f"<p>{say(2, 40)}</p>")}<label>{say(1, 5)}</label><input name=q><button>{say(1, 2)}</button><p>{say(2, 12)}</p></form>'
        if kind == "related":
            return f'<{(t := pick("div", "section"))} class="{pick("related", "recommended", "more stories", "popular", "tags")}"><h3>{say(1, 4)}</h3><ul>{links(4)}</ul></{t}>'
        if kind == "share":
            return f'<div class="{pick("share", "social", "breadcrumb", "breadcrumbs", "byline", "meta", "pagination")}">{say(1, 6)} <a href="#">{say(1, 2)}</a></div>'
        return f'<ul class="{pick("menu", "nav", "navigation", "toolbar")}">{links(4)}</ul>'

    def comments() -> str:
        one = lambda: pick('<div class="comment"><b>{}</b><p>{}</p></div>', '<li class="comment"><p>{} {}</p></li>', "<p>{}</p><p>{}</p>", '<article class="comment"><h4>{}</h4><p>{}</p></article>').format(say(1, 2), say(1, 60))
        head, tail = pick(('<section id="comments">', "</section>"), ('<div class="comments">', "</div>"), ('<ol class="commentlist">', "</ol>"), ('<div id="disqus comments">', "</div>"), ('<div class="reader responses replies">', "</div>"))
        return head + pick("", "<h2>Comments</h2>") + "".join(one() for _ in range(rng.integers(1, 6))) + tail

    pages = []

    def add(page: str) -> None:
        bs = blocks(f"<html><head><title>x</title></head><body>{page}</body></html>")
        y = ["\x02" in b.text for b in bs]
        for b in bs:
            b.text = b.text.replace("\x02", "").strip() or "x"
        pages.append((bs, y))

    for _ in range(count):
        body = []
        if chance(0.4):
            body.append(f'<header{pick("", " class=site")}><h1>{say(1, 4)}</h1><p>{say(1, 8)}</p></header>')
        if chance(0.8):
            body.append(f"<nav><ul>{links(rng.integers(1, 8))}</ul></nav>")
        body += [junk() for _ in range(rng.integers(0, 3))]
        head, tail = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="content"><article class="post entry">', "</article></div>"), ('<div class="story body">', "</div>"))
        inner = [f"<h1>{say(1, 14, chr(2))}</h1>"] if chance(0.8) else []
        for _ in range(rng.integers(0, 14)):
            kind = rng.random()
            size = pick(2, 8, 40, 120)
            if kind < 0.72:
                inner.append(pick("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{} <a href='/y'>x</a></p>", "<p><i>{}</i></p>").format(say(1, size, chr(2))))
            elif kind < 0.78:
                inner.append(f"<h2>{say(1, 6, chr(2))}</h2>")
            elif kind < 0.84:
                inner.append("<ul>" + "".join(f"<li>{say(1, 12, chr(2))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                inner.append(f"<blockquote>{say(3, 30, chr(2))}</blockquote>")
            elif kind < 0.91:
                inner.append("<table><tr>" + "".join(f"<td>{say(1, 3, chr(2))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                inner.append(junk())
        body.append(head + "".join(inner) + (comments() if chance(0.1) else "") + tail)
        body += [junk() for _ in range(rng.integers(0, 2))]
        if chance(0.35):
            body.append(comments())
        if chance(0.8):
            body.append(f'<footer>{pick("&copy; ", "Copyright ", "")}{say(1, 20)}</footer>')
        add("".join(body))
    for _ in range(count // 8):  # pages laid out by tables, with a footer in a row, and fields without a form
        menu = f"<tr><td>{links(rng.integers(1, 6))}</td></tr>" if chance(0.6) else ""
        cell = "".join(f"<p>{say(4, 60, chr(2))}</p>" for _ in range(rng.integers(1, 5)))
        bare = pick("<fieldset><legend>{}</legend><label>{}</label><input name=q></fieldset>", "<fieldset><legend>{}</legend><label>{}</label><input name=q><input name=r></fieldset>", "<form><p>{}</p><input name=q><button>{}</button></form>", "<form><p>{} {}</p><input name=q></form>")
        fields = bare.format(say(1, 3), say(1, 3)) if chance(0.7) else ""
        foot = f"<tr><td>{pick('Copyright ', '&copy; ', 'Copyright &copy; ')}{rng.integers(1994, 2030)}{pick('', ' ' + say(1, 6))}</td></tr>"
        add(f"<table{pick('', ' width=600', ' class=layout')}>{menu}<tr><td><h1>{say(1, 8, chr(2))}</h1>{cell}{fields}</td></tr>{foot}</table>")
    return pages


def main_text(page: str | None, model: Crf) -> str:
    bs = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(bs, model.decode(bs), strict=True) if keep)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", model: Crf | None = None) -> DataFrame:
    """``(key, text)`` for every page; ``model`` defaults to one trained on ``labelled_pages()``."""
    model = model or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([main_text(h, model) for h in batch.columns[-1].to_pylist()], pa.string())], [*batch.schema.names[:-1], "text"])

    rest = [c for c in pages.columns if c not in (html, "text")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.select(*rest).dtypes)
    return pages.select(*rest, F.col(html)).mapInArrow(run, f"{kinds}, text string")
