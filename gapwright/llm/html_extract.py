"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks: stretches of text between block-level tags.  Each block has features of its ancestors
(tags, class and id words, nearest tag) and of its text (length, links, punctuation, place in the page).  The field has two
labels, main and other, a weight per feature and label and one per pair of neighbouring labels.

Skipped unread is only what a browser never shows as text: scripts, styles, templates, the head, the contents of form
controls, and the stand-in text of frames and media.  Such an element without an end tag ends at the next block tag.  A heading
inside a ``header`` element belongs to that header, also in an article; other headings in the article are main text.

It is trained on labelled pages: a sample of ``SAMPLE`` pages (smallest hash of their id among those with such an element) whose ``article`` or ``main``
element says which blocks are main text, and ``VARIANTS`` rearrangements of each in other markup (plain divisions with
usual class names, sidebars, notices, adverts, forms, reader comments made of the page's own sentences), labelled by
construction.  Training pages give at most ``MAX_BLOCKS`` blocks each; extraction reads whole pages and whole blocks, in time
about linear in their length.

Null and empty html give the empty text; broken markup is read as far as it goes; repeated rows are treated alike; null ids
and extra columns are carried.  Without any labelled page a few built-in sentences take the place of page text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.batches import pieces, texts_of

SAMPLE, VARIANTS, MAX_BLOCKS = 300, 3, 120
STEPS, RATE, DECAY = 120, 0.15, 1e-3

# Element names of the HTML standard by kind.
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre
section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template head title select textarea iframe canvas audio video desc annotation".split())
CODE = {"script", "style", "template"}                        # may hold their own start tag
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]{2,}")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARK = {t: re.compile(rf"<(/?){t}\b[^>]*>", re.I) for t in RAW}
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK - {'option', 'optgroup'}))})\b", re.I)


@dataclass
class Leaf:
    """A leaf block: its text, (tag, class and id words) of its ancestors, characters inside links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def _names(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    text = " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs))
    return tuple(_WORD.findall(_CAMEL.sub(" ", text).lower()))


def leaves(page: str) -> list[Leaf]:
    """Leaf blocks of a page in order."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    linked = at = 0
    endless: set[str] = set()                                 # kinds without an end tag in the rest of the page

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append(Leaf(text, tuple(stack), linked))
            buffer.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if any(t == "a" for t, _ in stack[-4:]):
                linked += len(text)

    def behind(tag: str) -> int:
        """Where reading goes on after a skipped element: behind its end tag; an unclosed one ends at the next block tag."""
        for mark in () if tag in endless else _MARK[tag].finditer(page, at):
            if mark[1]:
                return mark.end()
            if tag not in CODE:
                break
        else:
            endless.add(tag)
        block = _BLOCK.search(page, at)
        return block.start() if block else len(page)

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:                                              # end tag
            if any(t == tag for t, _ in stack):
                if tag in BLOCK:
                    flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW:
            if tag in BLOCK:
                flush()
            if not m[3].endswith("/"):
                at = behind(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                buffer.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            shut, fence = CLOSES.get(tag, {"p"}), FENCE.get(tag, {"td", "th", "table", "button"})
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in fence:
                    break
                if stack[k][0] in shut:
                    del stack[k:]
                    break
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append((tag, _names(m[3])))
    flush()
    return out


# Words in class and id names, and in texts, that pages use for their parts.
OTHER_NAMES = set("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright
disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted
recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget
feedback rating alert""".split())
OTHER_TAGS = {"nav", "aside", "footer", "form", "header", "menu", "button", "dialog", "fieldset", "option", "label", "noscript"}
OTHER_WORDS = set("""cookie cookies copyright subscribe newsletter login comment comments reply share advert advertisement sponsored menu
privacy terms rights reserved consent accept search related""".split())


def is_main(leaf: Leaf) -> bool | None:
    """What a page's own markup says: in an article or main element and in none of its side parts; None without either."""
    for tag, names in reversed(leaf.path):
        if tag in OTHER_TAGS or set(names) & OTHER_NAMES:
            return False
        if tag in ("article", "main"):
            return True
    return None


def described(blocks: list[Leaf]) -> list[list[str]]:
    """Feature names of every block."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.split()
        tags = {t for t, _ in b.path}
        names = {x for _, ns in b.path for x in ns}
        last = b.path[-1][0] if b.path else "none"
        nearest = next((t for t, _ in reversed(b.path) if t in OTHER_TAGS or t in ("article", "main")), "none")
        f = ["bias", "in=" + last, "near=" + nearest]
        f += ["tag=" + t for t in tags if t not in ("html", "body")]
        f += ["name=" + x for x in names]
        if names & OTHER_NAMES:
            f.append("side name")
        if tags & (OTHER_TAGS - {"header"}):
            f.append("side tag")
        if any(set(ns) & OTHER_NAMES or t in OTHER_TAGS for t, ns in b.path[-3:]):
            f.append("side close")
        f.append(f"words={min(6, len(words).bit_length())}")
        f.append(f"links={min(3, int(4 * b.linked / max(1, len(b.text))))}")
        if b.text[-1] in ".!?":
            f.append("sentence")
        if "©" in b.text:
            f.append("copyright")
        if 20 * sum(w.strip(".,!?:;").lower() in OTHER_WORDS for w in words) >= len(words):
            f.append("side word")
        f.append("first" if i == 0 else "last" if i == n - 1 else "inner")
        out.append(f)
    return out


SENTENCES = ("The river rose early that spring and the lower fields stood under water for a week.",
             "Nobody in the village had expected the bridge to hold, yet it did.", "Two letters arrived on the same day.",
             "She walked along the wall until the light had gone from the hills.")


def variants(main: list[str], seed: int) -> list[tuple[list[Leaf], list[int]]]:
    """Pages made of the given main texts in other markup, with a label per block."""
    draw = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(draw.integers(len(xs)))]
    spare = [s for t in main for s in re.split(r"(?<=[.!?])\s+", t)][:400] or list(SENTENCES)
    bit = lambda: spare[int(draw.integers(len(spare)))][:300]
    made = []
    for _ in range(VARIANTS):
        root = (("html", ()), ("body", ()))
        rows: list[tuple[Leaf, int]] = []

        def add(text, path, label, linked=0):
            if text.strip():
                rows.append((Leaf(" ".join(text.split()), root + tuple(path), linked), label))

        def side(kind):
            if kind == "nav":
                box = pick(("nav", ()), ("div", ("menu",)), ("ul", ("navbar",)), ("header", ("site", "header")), ("div", ("breadcrumbs",)))
                for _ in range(int(draw.integers(2, 7))):
                    w = bit().split()[0]
                    add(w, (box, ("ul", ()), ("li", ()), ("a", ())), 0, len(w))
            elif kind == "comments":
                box = pick(("div", ("comments",)), ("section", ("comments",)), ("div", ("disqus", "thread")), ("ol", ("comment", "list")))
                for _ in range(int(draw.integers(1, 5))):
                    add(bit(), (box, ("div", ("comment",)), ("p", ())), 0)
            elif kind == "form":
                add(bit(), (("form", pick((), ("newsletter",), ("search",))), pick(("label", ()), ("p", ()), ("div", ()))), 0)
            else:
                box = pick(("aside", ()), ("div", ("ad",)), ("div", ("sidebar",)), ("div", ("cookie", "notice")), ("section", ("related",)),
                           ("div", ("advert",)), ("div", ("promo", "banner")), ("aside", ("widget",)), ("div", ("share", "social")), ("div", ("notice",)))
                for _ in range(int(draw.integers(1, 3))):
                    add(bit(), (box, *pick((), (("p", ()),), (("ul", ()), ("li", ())))), 0)

        for kind in ("nav", pick("box", "none"), pick("box", "form", "none")):
            if kind != "none":
                side(kind)
        box = pick((("article", ()),), (("main", ()),), (("main", ()), ("article", ())), (("div", ("content",)),), (("div", ("post", "body")),),
                   (("section", ("article", "text")),), (("div", ("main",)), ("div", ("entry", "content"))), (("div", ("story",)),))
        for k, text in enumerate(main):
            tag = "h1" if k == 0 and draw.random() < 0.6 else pick("p", "p", "p", "p", "h2", "li", "blockquote", "div", "td", "pre")
            path = (("ul", ()), ("li", ())) if tag == "li" else (("table", ()), ("tr", ()), ("td", ())) if tag == "td" else ((tag, ()),)
            add(text, (*box, *path), 1)
            if draw.random() < 0.08:
                inner = pick(("div", ("ad",)), ("aside", ()), ("div", ("share",)), ("form", ()), ("div", ("newsletter", "signup")))
                add(bit(), (*box, inner, *pick((), (("p", ()),))), 0)
        if draw.random() < 0.4:
            add(bit(), (*box, ("div", ("comments",)), ("div", ("comment",)), ("p", ())), 0)
        for kind in (pick("comments", "none"), pick("box", "nav", "form", "none")):
            if kind != "none":
                side(kind)
        foot = pick(("footer", ()), ("div", ("footer",)), ("footer", ("site", "footer")))
        add(pick("© ", "Copyright ", "") + bit()[:80], (foot, *pick((), (("p", ()),))), 0)
        made.append(([r for r, _ in rows], [y for _, y in rows]))
    return made


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "__html"):
        feats, labels = [], []
        for seed, page in zip(batch.column("seed").to_pylist(), texts_of(batch.column("__html")).to_pylist()):
            blocks = leaves(page)[:MAX_BLOCKS]
            said = [is_main(b) for b in blocks]
            if True not in said:
                continue
            pages = [(blocks, [int(y is True) for y in said]), *variants([b.text for b, y in zip(blocks, said) if y], seed & 0x7FFFFFFF)]
            for bs, ys in pages:
                feats.append(described(bs))
                labels.append(ys)
        yield pa.RecordBatch.from_arrays([pa.array(feats, pa.list_(pa.list_(pa.string()))), pa.array(labels, pa.list_(pa.int32()))], ["features", "labels"])


class Field:
    """Weights of the random field."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.weights = {f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in names.items()}
        self.moves = moves.tolist()

    def labels(self, features: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not features:
            return []
        get = self.weights.get
        (m00, m01), (m10, m11) = self.moves
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, fs in enumerate(features):
            e0 = e1 = 0.0
            for f in fs:
                w = get(f)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if k:
                x0, y0, x1, y1 = a + m00, b + m10, a + m01, b + m11
                back.append((int(y0 > x0), int(y1 > x1)))
                a, b = max(x0, y0) + e0, max(x1, y1) + e1
            else:
                a, b = e0, e1
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Maximum likelihood with L2 by Adam; all sequences advance together in forward and backward passes."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    flat = [names.setdefault(f, len(names)) for fs, _ in pages for block in fs for f in block]
    per = np.array([len(block) for fs, _ in pages for block in fs])
    starts = np.concatenate([[0], np.cumsum(per)])[:-1]
    flat = np.array(flat)
    size = np.array([len(ys) for _, ys in pages])
    truth = np.array([y for _, ys in pages for y in ys])
    row = np.repeat(np.arange(len(pages)), size)
    col = np.arange(len(truth)) - np.repeat(np.cumsum(size) - size, size)
    n, t = len(pages), int(size.max())
    present = np.zeros((n, t), bool)
    present[row, col] = True
    param = np.zeros((len(names) + 2, 2))                      # last two rows: moves
    m, v = np.zeros_like(param), np.zeros_like(param)
    gold = np.zeros_like(param)
    owner = np.repeat(np.arange(len(truth)), per)
    np.add.at(gold, (flat, truth[owner]), 1)
    pair = col > 0
    np.add.at(gold, (len(names) + truth[np.flatnonzero(pair) - 1], truth[pair]), 1)
    for step in range(1, STEPS + 1):
        score = np.zeros((n, t, 2))
        score[row, col] = np.add.reduceat(param[flat], starts, axis=0)
        moves = param[-2:]
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = score[:, 0]
        for k in range(1, t):
            new = np.logaddexp(alpha[:, k - 1, 0, None] + moves[0], alpha[:, k - 1, 1, None] + moves[1]) + score[:, k]
            alpha[:, k] = np.where(present[:, k, None], new, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            ahead = score[:, k + 1] + beta[:, k + 1]
            new = np.logaddexp(moves[:, 0] + ahead[:, 0, None], moves[:, 1] + ahead[:, 1, None])
            beta[:, k] = np.where(present[:, k + 1, None], new, 0.0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        prob = np.exp(alpha + beta - total[:, None, None])[row, col]
        want = np.zeros_like(param)
        for y in (0, 1):
            want[:len(names), y] = np.bincount(flat, prob[owner, y], len(names))
        both = np.exp(alpha[:, :-1, :, None] + moves + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        want[-2:] = (both * present[:, 1:, None, None]).sum(axis=(0, 1))
        grad = (want - gold) / n + DECAY * param
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        param -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field(names, param[:-2], param[-2:])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Field:
    """A field trained on a bounded sample of the pages."""
    key = F.xxhash64(id_col)
    labelled = F.col(html_col).rlike(r"(?i)<(article|main)\b")
    chosen = pages.filter(labelled).select(key.alias("seed"), F.col(html_col).alias("__html")).orderBy("seed").limit(sample)
    rows = [(list(map(list, r[0])), list(r[1])) for r in chosen.mapInArrow(_training_rows, "features array<array<string>>, labels array<int>").collect()]
    if not rows:
        rows = [(described(bs), ys) for k in range(40) for bs, ys in variants(list(SENTENCES), k)]
    return train(rows)


def main_text(field: Field, page: str | None) -> str:
    """Main text of one page."""
    blocks = leaves(page or "")
    return "\n\n".join(b.text for b, y in zip(blocks, field.labels(described(blocks))) if y)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in pieces(batches, "__html"):
            texts = [main_text(field, p) for p in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], ["__row", "text"])
    return run


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows of ``pages`` as the struct ``__row`` with ``text``."""
    field = field or fit(pages, id_col, html_col)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns if c != html_col)).alias("__row"), F.col(html_col).alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(field)          # a few hundred weights
    return rows.mapInArrow(_extract(shared), f"__row {rows.schema['__row'].dataType.simpleString()}, text string")
