"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks (operator 4).

A page is read once from left to right; text between block-level tags is a leaf block with the stack of
open elements above it. Void and optional-end tags are closed as browsers do (a head by the first start tag
or text that can't stand in it); what a hidden or aria-hidden attribute hides carries no blocks; scripts, styles, heads,
templates and comments carry no blocks; the text of formulas and drawings stays in its block. Features are the ancestors' tags, the words of their class, id and
role, and the text (length, share of link text, end mark, copyright and cookie words). The labels are
body and rest; weights are trained on labelled pages (``training_pages``, templates of common layouts with
known articles) by the gradient of the log-likelihood, and a page is decoded by Viterbi over all its blocks.

Nulls: a null, empty or text-free page gives the empty text. Broken markup never fails: a ``<`` that
begins no tag is text, open elements end with the page. Repeated rows are extracted each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfengine.llm.common import bounded_batches, table

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object select option datalist canvas audio video textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp img input button".split())
#: Formulas and drawings stand inside a line, whatever elements they hold; these parts of them are not shown.
FOREIGN = frozenset("svg math".split())
FOREIGN_SILENT = frozenset("desc metadata defs annotation annotation-xml".split())
#: What a start tag closes if it is open (elements whose end tag may be left out).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Start tags that may stand in a head; any other one ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))[^>\"']*)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=/]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block:
    """One leaf block: its text, its ancestors (tag, names) and how much of it stands in links."""

    __slots__ = ("text", "above", "linked")

    def __init__(self, text: str, above: tuple, linked: int):
        self.text, self.above, self.linked = text, above, linked


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    hides: list[bool] = []
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    silent = links = foreign = 0

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip()
            if text:
                linked = sum(len(_SPACE.sub(" ", p)) for p, inside in pieces if inside)
                out.append(Block(text, tuple(stack), linked))
            pieces.clear()

    def pop() -> None:
        nonlocal silent, links, foreign
        tag, _ = stack.pop()
        foreign -= tag in FOREIGN
        silent -= hides.pop()
        links -= tag == "a"

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if stack and stack[-1][0] == "head" and text.strip(" \t\n\r\f"):
            pop()
        if text and not silent:
            pieces.append((text, links > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if foreign and (tag in ENDS_P or tag in CLOSES) and not any(t == "foreignobject" for t, _ in stack):
            # an element of the page ends a formula or drawing left open
            while foreign:
                pop()
        inline = tag in INLINE or tag in FOREIGN or foreign > 0
        if m[1]:
            if not inline:
                flush()
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop()
        if not inline:
            flush()
        if tag in ENDS_P and not foreign:
            # a block ends an open paragraph, and the inline elements left open in it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                while len(stack) > k:
                    pop()
                break
            if tag not in CLOSES or stack[k][0] in ("ul", "ol", "dl", "table", "tbody"):
                break
        # a slash closes nothing whose content is raw text, but in a drawing it does
        if tag in VOID or m[0].endswith("/>") and (foreign or tag not in RAW):
            continue
        names: list[str] = []
        hidden = tag in SILENT or foreign > 0 and tag in FOREIGN_SILENT
        for key, value in _ATTRIBUTE.findall(m[3] or ""):
            key = key.lower()
            if key == "hidden" or key == "aria-hidden" and "true" in value:
                hidden = True
            elif key in ("class", "id", "role"):
                names += _NAME.findall(value.lower())
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((tag, tuple(names)))
        hides.append(hidden)
        silent += hidden
        links += tag == "a"
        foreign += tag in FOREIGN
    flush()
    return out


# Names that page authors give to parts outside of an article.
NAMES = {
    "ad": "ad ads advert advertisement advertising banner sponsor sponsored promo promoted adsense",
    "comment": "comment comments reply replies discussion disqus respond",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topbar",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead top logo branding",
    "side": "sidebar side aside related recommended widget popular trending newsletter subscribe share social",
    "notice": "cookie cookies consent notice gdpr popup modal alert overlay",
    "form": "form search login signup register",
    "main": "content article main post entry story body text",
}
_KIND = {w: k for k, ws in NAMES.items() for w in ws.split()}
_FOOT = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|subscribe|newsletter|advertisement", re.I)
#: One of these stands in every match of ``_FOOT``; plain searches are faster than the expression.
_FOOT_PARTS = ("©", "copyright", "all rights reserved", "cookie", "subscribe", "newsletter", "advertisement")


def _has_foot(text: str) -> bool:
    low = text.casefold().replace("i\u0307", "i").replace("ı", "i")
    return any(p in low for p in _FOOT_PARTS) and _FOOT.search(text) is not None


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for b in page:
        f = ["bias"]
        tags = {t for t, _ in b.above}
        f += [f"in:{t}" for t in sorted(tags - INLINE)]
        kinds = {_KIND[n] for _, names in b.above for n in names if n in _KIND}
        f += [f"kind:{k}" for k in sorted(kinds)]
        own = next((t for t, _ in reversed(b.above) if t not in INLINE), "")
        f.append(f"own:{own}")
        n = len(b.text)
        f.append(f"len:{min(6, n.bit_length() // 2)}")
        share = min(1.0, b.linked / max(1, n))
        f.append(f"link:{int(share * 4)}")
        f.append("end:stop" if b.text[-1:] in ".!?:;…\"" else "end:other")
        if _has_foot(b.text):
            f.append("foot")
        out.append(f)
    return out


class Chain:
    """A linear-chain CRF with labels 0 (rest) and 1 (body)."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, page: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for i, f in enumerate(page):
            known = [self.names[x] for x in f if x in self.names]
            out[i] = self.emit[known].sum(0)
        return out

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest label sequence (Viterbi)."""
        if not page:
            return []
        s, move = self.scores(page).tolist(), self.move.tolist()
        a, b, back = s[0][0], s[0][1], []
        for x, y in s[1:]:
            p, q = a + move[0][0], b + move[1][0]
            r, t = a + move[0][1], b + move[1][1]
            back.append((0 if p >= q else 1, 0 if r >= t else 1))
            a, b = max(p, q) + x, max(r, t) + y
        out = [0 if a >= b else 1]
        for k in reversed(back):
            out.append(k[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.3, ridge: float = 0.02) -> Chain:
    """Maximum likelihood by AdaGrad over the pages; marginals by forward and backward sums."""
    names = {x: i for i, x in enumerate(sorted({x for p, _ in pages for f in p for x in f}))}
    chain = Chain(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    sum_e, sum_m = np.full_like(chain.emit, 1e-8), np.full_like(chain.move, 1e-8)
    ids = [[[names[x] for x in f] for f in p] for p, _ in pages]
    for _ in range(steps):
        grad_e, grad_m = -ridge * chain.emit, -ridge * chain.move
        for (page, gold), cols in zip(pages, ids):
            if not page:
                continue
            s, n = chain.scores(page), len(page)
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0]
            for i in range(1, n):
                fwd[i] = s[i] + np.logaddexp.reduce(fwd[i - 1][:, None] + chain.move, axis=0)
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp.reduce(chain.move + s[i + 1] + bwd[i + 1], axis=1)
            total = np.logaddexp.reduce(fwd[-1])
            mark = np.exp(fwd + bwd - total)
            for i, c in enumerate(cols):
                grad_e[c, gold[i]] += 1
                grad_e[c] -= mark[i]
            for i in range(1, n):
                grad_m[gold[i - 1], gold[i]] += 1
                grad_m -= np.exp(fwd[i - 1][:, None] + chain.move + s[i] + bwd[i] - total)
        sum_e += grad_e**2
        sum_m += grad_m**2
        chain.emit += rate * grad_e / np.sqrt(sum_e)
        chain.move += rate * grad_m / np.sqrt(sum_m)
    return chain


def training_pages(count: int = 60, seed: int = 4) -> list[tuple[str, list[str]]]:
    """(html, texts of the article's blocks): pages of common layouts with drawn words."""
    rng = np.random.default_rng(seed)
    stems = "ra ten mol vi sur pel ka don ish ber lo gran tu mes fi ard".split()

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(stems, int(rng.integers(1, 4)))) for _ in range(n))

    def sentence(n: int | None = None) -> str:
        return words(n or int(rng.integers(1, 40))).capitalize() + rng.choice([".", ".", ".", ""])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(int(rng.integers(1, 3)))}</a></li>' for i in range(n))

    # such lines stand in articles as well as in footers
    legal = ["All rights reserved.", "Released under the MIT License.", "Subscribe to our newsletter.", "Copyright law has changed.", "We use cookies."]
    out = []
    for k in range(count):
        title, gold, body = sentence(int(rng.integers(1, 9))), [], []
        gold.append(title)
        for _ in range(int(rng.integers(0, 9))):
            kind = rng.choice(["p", "p", "p", "p", "h2", "ul", "blockquote", "pb", "pre", "table"])
            if kind == "ul":
                items = [sentence(int(rng.integers(2, 12))) for _ in range(3)]
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                gold += items
            elif kind == "table":
                items = [words(2) for _ in range(4)]
                body.append("<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(items[::2], items[1::2])) + "</table>")
                gold += items
            elif kind == "pb":
                x = sentence()
                body.append(f'<p><b>{x}</b> <a href="#">{words(2)}</a>.<br><p>')
                body.append("")
                gold.append(None)
                gold[-1] = _last(body[-2])
            else:
                x = sentence() if rng.random() < 0.8 else f"{rng.choice(legal)}{rng.choice(['', ' ' + sentence()])}"
                body.append(f"<{kind}>{x}</{kind}>")
                gold.append(x)
        wrap = [("<article>", "</article>"), ('<main><div class="content">', "</div></main>"), ('<div id="content" class="post">', "</div>"),
                ('<div class="article-body">', "</div>"), ("<main><article>", "</article></main>")][k % 5]
        noise = [
            f'<div class="ad">{sentence()}</div>', f'<div class="advert sponsored"><p>{sentence()}</p></div>', f'<aside class="sidebar"><h3>{words(2)}</h3><ul>{links(4)}</ul></aside>',
            f'<div id="cookie-notice"><p>We use cookies. {sentence()}</p><button>Accept</button></div>', f'<form class="search"><label>{words(1)}</label><input name="q"><button>Go</button></form>',
            f'<section class="comments"><h3>Comments</h3><div class="comment"><p>{sentence()}</p></div><div class="comment"><p>{sentence()}</p></div></section>',
            f'<div class="related"><h4>{words(2)}</h4><ul>{links(3)}</ul></div>', f'<div class="newsletter"><p>Subscribe to our newsletter. {sentence()}</p></div>',
            f'<div role="alert" class="notice">{sentence()}</div>', f'<ul class="breadcrumbs">{links(3)}</ul>', f'<div id="comments"><ol><li><p>{sentence()}</p></li></ol></div>',
            f"<aside><p>{sentence()}</p></aside>",
        ]
        before = "".join(rng.choice(noise, int(rng.integers(0, 3)), replace=False))
        inside = "".join(rng.choice(noise, int(rng.integers(0, 2)), replace=False))
        after = "".join(rng.choice(noise, int(rng.integers(0, 4)), replace=False))
        cut = int(rng.integers(0, len(body) + 1))
        body.insert(cut, inside)
        nav = rng.choice(["<nav><ul>%s</ul></nav>", '<div class="menu"><ul>%s</ul></div>', "<header><h2>Site</h2><nav><ul>%s</ul></nav></header>", '<div id="header"><a href="/">Home</a><ul class="nav">%s</ul></div>'])
        foot = rng.choice(["<footer>&copy; site &middot; %s</footer>", '<div id="footer"><p>%s</p></div>', "<footer><p>%s</p><p>All rights reserved.</p></footer>"]) % sentence()
        page = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{nav % links(5)}{before}{wrap[0]}<h1>{title}</h1>{''.join(body)}{wrap[1]}{after}{foot}</body></html>"
        out.append((page, gold))
    return out


def _last(fragment: str) -> str:
    return blocks(fragment)[-1].text


def trained() -> Chain:
    pages = []
    for page, gold in training_pages():
        found, at, marks = blocks(page), 0, []
        for b in found:
            own = {n for _, names in b.above for n in names} | {t for t, _ in b.above}
            inside = at < len(gold) and b.text == gold[at] and not own & {"nav", "footer", "aside", "form", "title"}
            at += inside
            marks.append(int(inside))
        assert at == len(gold), (gold[at], page)
        pages.append((features(found), marks))
    return train(pages)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, chain.decode(features(found))) if keep)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, held.value) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
