"""Main text of web pages by a linear-chain conditional random field.

A page becomes its leaf blocks: runs of text between block-level tags, each with
the tags and class words of the elements around it. The field scores every block
with ancestor and text features and every pair of neighbours with a transition;
weights are trained here, on labelled pages, by gradient ascent on the likelihood
(forward-backward), and the best sequence of labels is decoded by Viterbi.

A labelled page is (html, main text). Without any of the user's own, pages are
generated by :func:`labelled_pages`, a bounded sample (``TRAIN_PAGES``).
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import pick

TRAIN_PAGES = 600
EPOCHS = 120

#: Where markup begins; a "<" before anything else is text.
_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE_OR_END = re.compile(r"[>=]")
_UNQUOTED = re.compile(r"[^\s>]*")
_BLANKS = re.compile(r"\s*")
#: Elements whose content is no text of the page, whatever it is. What a formula's source says, no browser shows.
_RAW = frozenset(["script", "style", "noscript", "template", "title", "svg", "iframe", "textarea", "select", "annotation", "annotation-xml"])
#: What ends an element besides its own end tag, before it: a formula's end, another list of choices, and for drawings the HTML that browsers don't allow in them.
_RAW_ALSO = {"annotation": r"|(?=</math\b)", "annotation-xml": r"|(?=</math\b)", "select": r"|(?=<select[\s/>])", "svg": r"|(?=<(?:/?p|/?br|blockquote|body|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|img|li|listing|menu|meta|ol|pre|ruby|span|strong|strike|sub|sup|small|table|ul|var|b|i|s|u|tt|big|nobr)[\s/>])"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])" + _RAW_ALSO.get(name, ""), re.I) for name in _RAW}
#: Unclosed ones of these hide nothing but themselves.
_MAY_STAY_OPEN = frozenset(["svg", "select"])
_MAY_CLOSE_ITSELF = frozenset(["svg", "annotation", "annotation-xml"])
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset(["hr"])
#: Opening one of these ends an open one of the same kind.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset(["ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot"])


def _tag_end(page: str, at: int) -> int:
    """The place of the ">" that ends a tag, or the page's end. A quote counts where a value begins, as in browsers; one that nothing closes is passed over."""
    while m := _ATTRIBUTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.start()
        at = _BLANKS.match(page, m.end()).end()
        quote = page[at : at + 1]
        if quote and quote in "\"'":
            close = page.find(quote, at + 1)
            at = close + 1 if close >= 0 else at + 1
        else:
            at = _UNQUOTED.match(page, at).end()
    return len(page)


def _tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Markup in page order: where it begins and ends, the tag's name (None for what only goes), whether it closes, its attributes. One pass, whatever the markup is."""
    at = 0
    while m := _MARKUP.search(page, at):
        name, closing = m[2], bool(m[1])
        if name is None:
            mark = "-->" if m[0] == "<!--" else ">"
            found = page.find(mark, m.end())
            at = found + len(mark) if found >= 0 else len(page)
            yield m.start(), at, None, False, ""
            continue
        name = name.lower()
        end = _tag_end(page, m.end())
        at = min(end + 1, len(page))
        if name in _RAW and not closing:
            if not (name in _MAY_CLOSE_ITSELF and page[end - 1] == "/"):
                found = _RAW_END[name].search(page, at)
                if found is not None:
                    at = min(_tag_end(page, found.end()) + 1, len(page)) if found[0] else found.start()
                elif name not in _MAY_STAY_OPEN:
                    at = len(page)
            yield m.start(), at, None, False, ""
        else:
            yield m.start(), at, name, closing, page[m.end() : end]


class Around:
    """An element with those around it: a node of a tree in which equal ways from the page are one node, so that what is known of a way is worked out once."""

    __slots__ = ("parent", "element", "children", "tree", "known", "sum", "score")

    def __init__(self, parent: Around | None = None, element: tuple[str, ...] = ()):
        self.parent, self.element, self.children = parent, element, None
        self.tree: list[int] = [0] if parent is None else parent.tree  # the number of nodes, shared by all
        self.tree[0] += 1
        self.known = self.sum = self.score = None

    def child(self, element: tuple[str, ...]) -> Around:
        if self.children is None:
            self.children = {}
        found = self.children.get(element)
        if found is None:
            found = self.children[element] = Around(self, element)
        return found

    def elements(self) -> list[tuple[str, ...]]:
        """From the page inwards."""
        out, at = [], self
        while at.parent is not None:
            out.append(at.element)
            at = at.parent
        return out[::-1]


def blocks(page: str | None, root: Around | None = None) -> list[tuple[str, Around, float]]:
    """Leaf blocks in page order: text, the element around it with its ancestors (below ``root``), share of characters in links."""
    if not page:
        return []
    out: list[tuple[str, Around, float]] = []
    stack: list[Around] = [root or Around()]
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                out.append((text, stack[-1], min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def last(tags) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    def close(tags: tuple[str, ...], scopes: frozenset = frozenset()) -> None:
        """Close the innermost element of one of the tags with all in it, unless a scope stands in between."""
        k = last(tags)
        if k and k >= (last(scopes) if scopes else 0):
            for node in stack[k:]:
                places[node.element[0]].pop()
            del stack[k:]

    for begins, ends, tag, closing, attributes in _tags(page):
        if begins > at:
            raw = page[at:begins]
            parts.append(raw)
            if in_link:
                linked += len(raw)
        at = ends
        if tag is None:
            continue
        if tag in _BLOCK_TAGS:
            end_block()
            if closing:
                close((tag,))
                continue
            close(("p",), _SCOPES)
            if tag in _ENDS:
                close(_ENDS[tag], _SCOPES)
            if tag not in _VOID:
                names = [w for a in _ATTRIBUTE.findall(attributes) for w in _NAME.findall((a[1] or a[2] or a[3]).lower())] if attributes else []
                places.setdefault(tag, []).append(len(stack))
                stack.append(stack[-1].child((tag, *names)))
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
    if at < len(page):
        parts.append(page[at:])
    end_block()
    return out


def _text_features(text: str, links: float) -> list[str]:
    words = text.count(" ") + 1
    return [
        "words:" + ("1" if words == 1 else "5" if words <= 5 else "12" if words <= 12 else "30" if words <= 30 else "many"),
        "links:" + ("none" if links == 0 else "some" if links < 0.4 else "most"),
        "end:" + ("stop" if text[-1] in ".!?…。\"”»" else "colon" if text[-1] == ":" else "word"),
        "sign:" + ("yes" if "©" in text or "·" in text or "|" in text else "no"),
    ]


_NEAR = frozenset(["article", "main", "nav", "header", "footer", "aside", "form", "section", "body"])


def _element_features(element: tuple[str, ...]) -> list[str]:
    return ["in:" + element[0]] * (element[0] not in ("html", "body")) + ["name:" + w for w in element[1:]]


def _place_features(around: list[tuple[str, ...]]) -> list[str]:
    """What the innermost elements say: their own tag, the nearest part of a page, whether it is in an article."""
    near = next((e[0] for e in reversed(around) if e[0] in _NEAR), "none")
    return ["own:" + around[-1][0]] * bool(around) + ["near:" + near] + ["inside"] * any(e[0] in ("article", "main") for e in around)


def features(block: tuple) -> list[str]:
    """Names of the features that are on for a block."""
    around = block[1].elements()
    return ["always", *_text_features(block[0], block[2]), *sorted({n for e in around for n in _element_features(e)} | set(_place_features(around)))]


class Field:
    """A linear-chain conditional random field with the labels 0 (other) and 1 (main text)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps  # (features, 2), (2, 2)
        self.root = Around()

    def __getstate__(self) -> dict:
        return {"names": self.names, "weights": self.weights, "steps": self.steps}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def tree(self) -> Around:
        """The root below which pages' blocks are put; a new one when the tree has grown large."""
        if self.root.tree[0] > 20_000:
            self.root = Around()
        return self.root

    def _sum(self, names: list[str]) -> float:
        return sum(float(self.weights[k, 1] - self.weights[k, 0]) for n in names if (k := self.names.get(n)) is not None)

    def _around(self, node: Around) -> float:
        """What an element and those around it add to a block's score. Each node adds what its ancestors have not got, so a deep page takes work in proportion."""
        way = []
        while node.known is None and node.parent is not None:
            way.append(node)
            node = node.parent
        if node.known is None:
            node.known, node.sum = (frozenset(), "none", False), self._sum(["always"])
        for inner in reversed(way):
            (names, near, inside), tag = node.known, inner.element[0]
            new = {n for n in _element_features(inner.element) if n in self.names and n not in names}
            inner.known = (names | new if new else names, tag if tag in _NEAR else near, inside or tag in ("article", "main"))
            inner.sum = node.sum + self._sum(sorted(new))
            node = inner
        if node.score is None:
            _, near, inside = node.known
            node.score = node.sum + self._sum(["own:" + node.element[0]] * bool(node.element) + ["near:" + near] + ["inside"] * inside)
        return node.score

    def scores(self, page: list[tuple]) -> list[float]:
        """By how much label 1 beats label 0, block by block, without its neighbours."""
        return [self._around(around) + self._sum(_text_features(text, links)) for text, around, links in page]

    def decode(self, page: list[tuple]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to label 0."""
        scores = self.scores(page)
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        best0, best1, back = 0.0, scores[0], []
        for s in scores[1:]:
            from0, from1 = best1 + s10 > best0 + s00, best1 + s11 > best0 + s01
            best0, best1 = (best1 + s10 if from0 else best0 + s00), (best1 + s11 if from1 else best0 + s01) + s
            back.append((from0, from1))
        label = int(best1 > best0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


class Batch:
    """Labelled pages (blocks, labels) as arrays; the likelihood of their labels and its gradient by forward-backward."""

    def __init__(self, pages: list[tuple[list[tuple], list[int]]]):
        pages = [(b, y) for b, y in pages if b]
        self.names: dict[str, int] = {}
        rows = [[[self.names.setdefault(n, len(self.names)) for n in features(x)] for x in b] for b, _ in pages]
        self.n, self.longest = len(pages), max(map(len, rows))
        self.page_of = np.concatenate([np.full(sum(map(len, r)), i) for i, r in enumerate(rows)])
        self.time_of = np.concatenate([np.repeat(np.arange(len(r)), list(map(len, r))) for r in rows])
        self.name_of = np.concatenate([np.concatenate(r) for r in rows])
        labels = np.full((self.n, self.longest), -1)
        for i, (_, y) in enumerate(pages):
            labels[i, : len(y)] = y
        self.mask = labels >= 0
        self.truth = np.stack([labels == 0, labels == 1], axis=2).astype(float)
        self.truth_steps = np.array([[((labels[:, :-1] == a) & (labels[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)

    def gradient(self, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of all labels, its gradient by the weights (features, 2) and by the steps (2, 2)."""
        mask, longest = self.mask, self.longest
        node = np.zeros((self.n, longest, 2))
        for y in (0, 1):
            np.add.at(node[:, :, y], (self.page_of, self.time_of), weights[self.name_of, y])
        forward, backward = np.zeros_like(node), np.zeros_like(node)
        forward[:, 0] = node[:, 0]
        for t in range(1, longest):
            forward[:, t] = node[:, t] + np.logaddexp(forward[:, t - 1, :1] + steps[0], forward[:, t - 1, 1:] + steps[1])
            forward[:, t] = np.where(mask[:, t, None], forward[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = node[:, t + 1] + backward[:, t + 1]
            backward[:, t] = np.where(mask[:, t + 1, None], np.stack([np.logaddexp(steps[a, 0] + ahead[:, 0], steps[a, 1] + ahead[:, 1]) for a in (0, 1)], axis=1), 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        chance = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        error = (self.truth - chance) * mask[:, :, None]
        by_weights = np.stack([np.bincount(self.name_of, error[self.page_of, self.time_of, y], len(self.names)) for y in (0, 1)], axis=1)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = (np.exp(forward[:, :-1, a] + steps[a, b] + node[:, 1:, b] + backward[:, 1:, b] - total[:, None]) * mask[:, 1:]).sum()
        value = float((node * self.truth).sum() + (self.truth_steps * steps).sum() - total.sum())
        return value, by_weights, self.truth_steps - expected


def train(pages: list[tuple[list[tuple], list[int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Weights that make the labels of ``pages`` (blocks, labels) likely; all pages in every step (Adagrad)."""
    batch = Batch(pages)
    weights, steps = np.zeros((len(batch.names), 2)), np.zeros((2, 2))
    seen_w, seen_s = np.full_like(weights, 1e-6), np.full_like(steps, 1e-6)
    for _ in range(epochs):
        _, by_weights, by_steps = batch.gradient(weights, steps)
        gradient, step_gradient = by_weights / batch.n - decay * weights, by_steps / batch.n - decay * steps
        seen_w += gradient**2
        seen_s += step_gradient**2
        weights += rate * gradient / np.sqrt(seen_w)
        steps += rate * step_gradient / np.sqrt(seen_s)
    return Field(batch.names, weights, steps)


def label_blocks(page: str, text: str) -> tuple[list[tuple], list[int]]:
    """Blocks of a labelled page, with 1 for those that its main text has, in order."""
    found = blocks(page)
    rest = text.split("\n\n")
    labels, at = [], 0
    for block in found:
        if at < len(rest) and block[0] == rest[at]:
            labels.append(1)
            at += 1
        else:
            labels.append(0)
    return found, labels


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, field.tree())
    return "\n\n".join(b[0] for b, y in zip(found, field.decode(found), strict=True) if y)


def _sentence(r: random.Random, least: int, most: int) -> str:
    words = ["".join(r.choice(("th", "an", "er", "in", "re", "on", "ou", "é", "sch", "ción", "ent", "ha", "le", "ti")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
    return " ".join(words).capitalize() + r.choice((".", ".", ".", ".", "", "!", "?", "&amp;&amp;", ":"))


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> list[tuple[str, str]]:
    """Pages of varied make with their main text: what surrounds it and what interrupts it is drawn at random."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        main: list[str] = []

        def prose(words: tuple[int, int] = (2, 60)) -> str:
            return " ".join(_sentence(r, 1, 25) for _ in range(r.randint(1, 5))) if r.random() < 0.6 else _sentence(r, *words)

        def keep(inner: str) -> str:
            main.append(_SPACE.sub(" ", html_lib.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|i|a|em|span)\b[^>]*>", "", inner)))).strip())
            return inner

        def links(k: int, tag: str = "ul") -> str:
            return f"<{tag}>" + "".join(f'<li><a href="/{i}">{_sentence(r, 1, 4)}</a></li>' for i in range(k)) + f"</{tag}>"

        def other(where: str) -> str:
            kind = r.choice(("nav", "ad", "aside", "notice", "form", "comments", "header", "footer", "related"))
            short = _sentence(r, 1, 30)
            if kind == "nav":
                return r.choice((f"<nav>{links(r.randint(2, 8))}</nav>", f'<div class="{r.choice(("menu", "navbar", "breadcrumb", "nav main-menu", "topnav"))}">{links(r.randint(2, 6))}</div>'))
            if kind == "ad":
                return f'<div class="{r.choice(("ad", "ads", "advert", "sponsor", "promo banner", "ad-slot", "advertisement"))}">{r.choice((short, f"<p>{short}</p>"))}</div>'
            if kind == "aside":
                inner = r.choice((f"<p>{prose()}</p>", links(4), f"<h3>{_sentence(r, 1, 4)}</h3><p>{prose()}</p>"))
                return r.choice((f"<aside>{inner}</aside>", f'<div class="{r.choice(("sidebar", "side", "widget", "sidebar right"))}">{inner}</div>', f'<div id="sidebar">{inner}</div>'))
            if kind == "notice":
                return f'<div class="{r.choice(("notice", "cookie-notice", "alert", "cookie banner", "consent", "disclaimer", "popup", "newsletter", "warning"))}"><p>{prose((3, 25))}</p></div>'
            if kind == "form":
                return f'<form action="/s" class="{r.choice(("search", "subscribe", "login", "f"))}"><label>{_sentence(r, 1, 4)}</label><input name="q"><p>{_sentence(r, 2, 12)}</p><button>{_sentence(r, 1, 2)}</button></form>'
            if kind == "comments":
                one = "".join(f'<{t} class="comment">{r.choice((f"<p>{prose()}</p>", prose()))}</{t}>' for t in [r.choice(("div", "li", "article"))] for _ in range(r.randint(1, 4)))
                return f'<{(t := r.choice(("section", "div")))} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "discussion", "replies", "reader-comments"))}"><h2>{_sentence(r, 1, 3)}</h2>{one}</{t}>'
            if kind == "related":
                return f'<div class="{r.choice(("related", "share", "social", "tags", "author-box", "more", "recommended"))}">{r.choice((links(3), f"<p>{short}</p>"))}</div>'
            if kind == "header":
                return r.choice((f"<header><h1>{_sentence(r, 1, 4)}</h1>{links(3)}</header>", f'<div class="header">{short}</div>', f"<header><p>{short}</p></header>")) if where == "outside" else ""
            return r.choice((f"<footer>&copy; {short} &middot; {_sentence(r, 2, 9)}</footer>", f'<div class="footer"><p>{short}</p></div>', f"<footer><p>{prose()}</p></footer>"))

        def piece() -> str:
            kind = r.random()
            if kind < 0.62:
                return f"<p>{keep(prose())}" + r.choice(("</p>", "</p>", "</p>", "", "\n"))
            if kind < 0.7:
                return f"<p><b>{keep(_sentence(r, 1, 20))}<br>"
            if kind < 0.78:
                return f"<h2>{keep(_sentence(r, 1, 7))}</h2>"
            if kind < 0.84:
                return "<ul>" + "".join(f"<li>{keep(_sentence(r, 2, 15))}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
            if kind < 0.88:
                return f"<blockquote><p>{keep(prose())}</p></blockquote>"
            if kind < 0.92:
                return f"<p>{keep(_sentence(r, 2, 9) + ' <a href="/x">' + _sentence(r, 1, 3) + '</a> ' + _sentence(r, 2, 20))}</p>"
            if kind < 0.94:
                return f"<table><tr><td>{keep(_sentence(r, 1, 5))}</td><td>{keep(_sentence(r, 1, 5))}</td></tr></table>"
            return other("inside")

        body = [other("outside") for _ in range(r.randint(0, 3))]
        opening, closing = r.choice((("<article>", "</article>"),) * 5 + (("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content" class="post">', "</div>"), ('<div class="article-body">', "</div>"), ('<section class="story entry">', "</section>")))
        title = f"<h1>{keep(_sentence(r, 1, 12))}</h1>" if r.random() < 0.7 else ""
        inner = title + "".join(piece() for _ in range(r.randint(1, 14)))
        body.append(opening + inner + closing)
        body += [other("outside") for _ in range(r.randint(0, 3))]
        out.append((f'<!DOCTYPE html><html><head><title>{_sentence(r, 1, 6)}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>' + r.choice(("", "<!-- x -->", "\n")).join(body) + r.choice(("</body></html>", "")), "\n\n".join(m for m in main if m)))
    return out


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", field: Field | None = None) -> DataFrame:
    """Every row of ``df`` once: page_id, url, text (main text, "" if none), n_chars.

    Null or empty html: no text. Broken markup: elements end where the page ends.
    Repeated rows give repeated results. Empty table: no rows. Other columns are
    not read. ``field``: trained weights; else they are trained on generated pages.
    """
    field = field or train([label_blocks(h, t) for h, t in labelled_pages()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=_TEXTS)

    pages = pick(df, page_id=page_id, url=url, html=html).select(F.col("page_id").cast("long"), "url", "html")
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
