"""Main text of web pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

A page becomes a tree of block elements and runs of text. Every node has features of its subtree (text,
link and tag density), its depth, its place among its siblings and their statistics, its tag and attribute
tokens and those above it. Boosted trees give each node the log odds that it holds main text. Decoding
finds the best labels of the whole tree under the rule that a node below a rejected one is rejected, with
a price on each parent and child that differ, so that ancestors and descendants never contradict.

The trees are trained here, on pages that ``training_pages`` writes with known answers; their number is a
parameter, and no page of the table is learned from.

A null page is empty, and a page without main text has the text ''. Markup is read tolerantly: unclosed
elements, stray end tags and an unfinished tag at the end are all accepted. Scripts, styles, buttons and the
like are skipped up to their own end tag; without one, only scripts and styles go on to the end of the page.
Pages are read whole, in time in proportion to their length. References are decoded in each run of text between tags. Repeated rows get equal results. Only the html is read, whatever other columns are named.
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

from strandline.llm.boosting import BoostedTrees
from strandline.llm.bytetext import by_bytes

# fixed values: the vocabulary of HTML, and the attribute tokens that count
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select button".split())
#: Of these, the ones whose contents are no markup, and the ones whose contents are code even if they never end.
LITERAL = frozenset("script style textarea title iframe".split())
CODE = frozenset("script style".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split()
)
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "button": {"button"}, "select": {"select"}}
SCOPES = frozenset("ul ol dl table body html article section div".split())
TOKEN_GROUPS = (
    "article content post entry main story body text",
    "nav navbar navigation menu breadcrumb breadcrumbs toc",
    "header masthead banner top topbar logo",
    "footer foot bottom copyright colophon",
    "sidebar side aside widget related recommended rail",
    "ad ads advert advertisement sponsor sponsored promo promotion adbox",
    "cookie cookies notice consent alert popup modal gdpr overlay",
    "comment comments reply replies discussion respond reader",
    "form login search subscribe newsletter signup",
    "share social tags byline meta",
)
TAG_GROUPS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "h1 h2 h3 h4 h5 h6", "p blockquote pre", "li", "ul ol dl", "td th tr table", "#text")

_TOKEN_BIT = {t: 1 << k for k, g in enumerate(TOKEN_GROUPS) for t in g.split()}
_STEMS = tuple((t, bit) for t, bit in _TOKEN_BIT.items() if len(t) > 4)
_TAG_BIT = {t: 1 << (k + len(TOKEN_GROUPS)) for k, g in enumerate(TAG_GROUPS) for t in g.split()}
_N_BITS = len(TOKEN_GROUPS) + len(TAG_GROUPS)
#: Pages are read by this many bytes at once.
SLICE_BYTES = 1 << 20
#: Attribute tokens whose groups a task remembers; those of others are found anew.
REMEMBERED = 10_000
# a quote opens a value only behind an equals sign, and if it is closed; nothing is tried twice, so values have any length
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S
)
_LITERAL_TAG = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in LITERAL}
_LITERAL_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in LITERAL}
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


def _token_bits(token: str) -> int:
    """The group of an attribute token, by the whole of it or by a stem that it starts with."""
    if (bit := _TOKEN_BIT.get(token)) is None:
        bit = next((b for t, b in _STEMS if token.startswith(t)), 0)
        if len(token) < 40 and len(_TOKEN_BIT) < REMEMBERED:
            _TOKEN_BIT[token] = bit
    return bit


def _tags(source: str) -> tuple[list[tuple[re.Match, str, int]], dict[int, int]]:
    """All markup of a page as (match, tag, where reading goes on), and the end tag of each element to be skipped.

    The tag is empty for comments and for an unfinished tag. A literal element is one entry with its contents.
    """
    tags: list[tuple[re.Match, str, int]] = []
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    single: dict[str, int] = {}  # a self-closed form, which only an end tag that comes next makes an element with contents
    endless: set[str] = set()
    at, n = 0, len(source)
    while at < n and (m := _TAG.search(source, at)):
        at = m.end()
        tag = m[2].lower() if m[2] is not None and m[0][-1] == ">" else ""
        k = len(tags)
        if tag in LITERAL and not m[1]:
            own = None
            if m[3][-1:] != "/":
                own = None if tag in endless else _LITERAL_END[tag].search(source, at)
                if own is None:
                    endless.add(tag)
                    at = n if tag in CODE else at
            elif (near := _LITERAL_TAG[tag].search(source, at)) and near[1]:
                own = _LITERAL_END[tag].match(source, near.start())
            if own or at == n:
                ends[k] = k
            at = own.end() if own else at
        elif tag in RAW and m[1]:
            if opened.get(tag):
                ends[opened[tag].pop()] = k
            elif tag in single:
                ends[single[tag]] = k
            single.pop(tag, None)
        elif tag in RAW:
            single.pop(tag, None)
            if m[3][-1:] != "/":
                opened.setdefault(tag, []).append(k)
            elif tag != "svg":
                single[tag] = k
        tags.append((m, tag, at))
    return tags, ends


class Page:
    """The nodes of one page in document order, as parallel lists. Node 0 is the page itself."""

    __slots__ = ("above", "bits", "depth", "end", "links", "parent", "pieces", "place", "text")

    def __init__(self, source: str):
        self.parent, self.depth, self.bits, self.above, self.place = [-1], [0], [0], [0], [0]
        self.end, self.text, self.links = [0], [""], [0]
        self.pieces: list[str] = []
        children = [0]
        stack: list[tuple[str, int]] = []  # open elements; inline ones have node -1, and closed ones of these no tag
        opened: dict[str, list[int]] = {}  # where the open elements of each tag lie in it
        blocks: list[int] = []  # and the block elements
        links = linked = 0

        def add(tag: str, bits: int) -> int:
            p, node = stack[blocks[-1]][1] if blocks else 0, len(self.parent)
            self.parent.append(p), self.depth.append(self.depth[p] + 1), self.bits.append(bits)
            self.above.append(self.above[p] | self.bits[p]), self.place.append(children[p])
            self.end.append(node + 1), self.text.append(""), self.links.append(0)
            children[p] += 1
            children.append(0)
            return node

        def flush() -> None:
            nonlocal linked
            if self.pieces:
                text = _SPACE.sub(" ", "".join(self.pieces)).strip()
                self.pieces = []
                if text:
                    node = add("#text", _TAG_BIT["#text"])
                    self.text[node], self.links[node] = text, min(linked, len(text))
                linked = 0

        def push(tag: str, node: int) -> None:
            opened.setdefault(tag, []).append(len(stack))
            if node >= 0:
                blocks.append(len(stack))
            stack.append((tag, node))

        def close(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                tag, node = stack[-1]
                if node >= 0:
                    flush()
                    self.end[node] = len(self.parent)
                    blocks.pop()
                elif tag == "a":
                    links -= 1
                stack.pop()
                if tag:
                    opened[tag].pop()

        def last(tags: frozenset[str] | set[str] | tuple) -> int:
            return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

        tags, ends = _tags(source)
        at, n, k_tag = 0, len(source), 0
        while at < n:
            m, tag, after = tags[k_tag] if k_tag < len(tags) else (None, "", n)
            stop = m.start() if m else n
            if stop > at:
                piece = html_lib.unescape(source[at:stop])
                self.pieces.append(piece)
                if links:
                    linked += len(piece)
            if not m:
                break
            own, at = k_tag, after
            k_tag += 1
            if not tag:
                continue
            if m[1]:
                k = last((tag,))
                if k >= 0 and stack[k][1] >= 0:
                    close(k)
                elif k >= 0 and not (blocks and k < blocks[-1]):
                    stack[k] = ("", -1)
                    opened[tag].pop()
                    if tag == "a":
                        links -= 1
                continue
            if tag in LITERAL or (tag in RAW and (own in ends or m[3][-1:] == "/")):
                if own in ends:
                    k_tag, at = ends[own] + 1, tags[ends[own]][2]
                self.pieces.append(" ")
                continue
            if tag == "br":
                self.pieces.append(" ")
            if tag in VOID and tag != "hr":
                continue
            if tag in INLINE:
                if tag == "a":
                    links += 1
                push(tag, -1)
                continue
            flush()
            closing = last((*SAME_CLOSES.get(tag, ()), *(("p",) if tag in CLOSES_P else ())))
            if closing > last(SCOPES):
                close(closing)
            if tag == "hr":
                continue
            bits = _TAG_BIT.get(tag, 0)
            if m[3]:
                for a in _ATTRIBUTE.finditer(m[3]):
                    for token in re.split(r"[^a-z]+", (a[1] or a[2] or a[3] or "").lower()):
                        bits |= _token_bits(token)
            push(tag, add(tag, bits))
        close(0)
        flush()
        self.end[0] = len(self.parent)


def features(pages: list[Page]) -> np.ndarray:
    """A row for each node of all pages, in order."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)

    def column(name: str) -> np.ndarray:
        return np.array([v for p in pages for v in getattr(p, name)], np.int64)

    parent, end, depth, place = column("parent"), column("end") + first, column("depth"), column("place")
    at = np.arange(len(first))
    parent = np.where(parent < 0, at, parent + first)
    texts = [t for p in pages for t in p.text]
    own = {
        "chars": np.array([len(t) for t in texts]),
        "links": column("links"),
        "words": np.array([t.count(" ") + 1 if t else 0 for t in texts]),
        "marks": np.array([len(_PUNCTUATION.findall(t)) for t in texts]),
        "runs": np.array([1 if t else 0 for t in texts]),
    }
    sums = {}
    for k, v in own.items():
        c = np.concatenate([[0], np.cumsum(v)])
        sums[k] = c[end] - c[at]
    n = end - at
    whole = np.maximum(sums["chars"][first], 1)
    n_siblings = np.bincount(parent, minlength=len(at))[parent]
    around = np.bincount(parent, sums["chars"], len(at))[parent]
    around_links = np.bincount(parent, sums["links"], len(at))[parent]
    chars = np.maximum(sums["chars"], 1)
    numbers = [
        np.log1p(sums["chars"]), np.log1p(sums["words"]), sums["links"] / chars, sums["marks"] / np.maximum(sums["words"], 1), chars / n, np.log1p(n),
        sums["chars"] / whole, depth, place, place / np.maximum(n_siblings, 1), n_siblings, around / np.maximum(n_siblings, 1), around_links / np.maximum(around, 1),
        sums["chars"] / np.maximum(around, 1), sums["chars"][parent] / whole, sums["chars"] / np.maximum(sums["runs"], 1), (at - first) / np.maximum(sizes.repeat(sizes), 1),
    ]
    shifts = np.arange(_N_BITS)
    flags = [(column(name)[:, None] >> shifts) & 1 for name in ("bits", "above")]
    return np.concatenate([np.stack(numbers, axis=1), *flags], axis=1)


def decode(page: Page, score: list[float], price: float = 1.0) -> list[bool]:
    """The best consistent labels: a node is accepted only if its parent is."""
    best = list(score)
    for i in range(len(best) - 1, 0, -1):
        best[page.parent[i]] += max(best[i], -price)
    label = [True] * len(best)
    for i in range(1, len(best)):
        label[i] = label[page.parent[i]] and best[i] > -price
    return label


def _words(rng: random.Random, n: int) -> str:
    parts = "ka lo mi ten ra su vel or in dan pe sho tri al gen us mor fa ble ing".split()
    out = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))
    return out[:1].upper() + out[1:] + rng.choice([".", ".", ".", "!", "?", ""])


def _prose(rng: random.Random) -> str:
    return " ".join(_words(rng, rng.randint(1, 25)) for _ in range(rng.choice([1, 1, 1, 2, 3, 5])))


def _boilerplate(rng: random.Random, kind: str) -> str:
    """One part of a page that is not main text, marked by tag, by token, or by both."""
    tag, tokens = {
        "nav": ("nav", 1), "header": ("header", 2), "footer": ("footer", 3), "aside": ("aside", 4), "ad": ("div", 5), "notice": ("div", 6),
        "comments": ("section", 7), "form": ("form", 8), "share": ("div", 9),
    }[kind]
    name = rng.choice(TOKEN_GROUPS[tokens].split())
    name += rng.choice(["", "", "list", "s"]) if len(name) > 4 else ""
    plain = rng.random()
    attribute = "" if plain < 0.3 and tag not in ("div", "section") else f' {rng.choice(["class", "id"])}="{name}{rng.choice(["", "", "-box", " x1"])}"'
    if plain > 0.6:
        tag = "div"
    if kind in ("nav", "share") or kind == "aside" and rng.random() < 0.5:
        inner = "<ul>" + "".join(f'<li><a href="#">{_words(rng, rng.randint(1, 4))}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"
    elif kind == "form":
        inner = f"<p>{_words(rng, 5)}</p><label>{_words(rng, 2)}</label><input><button>{_words(rng, 1)}</button>"
    elif kind == "comments":
        inner = f"<h3>{_words(rng, 2)}</h3>" + "".join(
            f'<div class="{rng.choice(["comment", "reply", "item"])}"><b>{_words(rng, 1)}</b><p>{_prose(rng)}</p></div>' for _ in range(rng.randint(1, 5))
        )
    elif kind == "footer":
        inner = f"&copy; {_words(rng, rng.randint(2, 12))}" + (f'<a href="#">{_words(rng, 2)}</a>' if rng.random() < 0.5 else "")
    elif kind == "header":
        shape = rng.choice(['<a href="/">{}</a> {}', "<h1>{}</h1><p>{}</p>", "<span>{}</span> {}", "<h2>{}</h2>{}", "{} {}"])
        inner = shape.format(_words(rng, rng.randint(1, 3)), _words(rng, rng.randint(1, 5)) if rng.random() < 0.7 else "")
    else:
        inner = rng.choice(["{}", "<p>{}</p>", "<b>{}</b>"]).format("\n".join(_words(rng, rng.randint(2, 14)) for _ in range(rng.randint(1, 4))))
    return f"<{tag}{attribute}>{inner}</{tag}>"


def training_pages(n: int, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Pages with the texts of their main blocks. Main texts are marked by a rare ending, so that they are known."""
    rng = random.Random(seed)
    for _ in range(n):
        main: set[str] = set()

        def keep(text: str) -> str:
            main.add(_SPACE.sub(" ", text).strip())
            return text

        title = keep(_words(rng, rng.randint(1, 12)))
        blocks = [f"<h1>{title}</h1>"]
        bare = rng.random() < 0.08
        if not bare and rng.random() < 0.15:
            line = f'<p class="{rng.choice(["byline", "meta", "tags"])}">{_words(rng, 4)}</p>'
            blocks = [rng.choice(["<header>{}</header>", "{}"]).format(blocks[0] + line)]
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 14])):
            shape = rng.random()
            if shape < 0.72:
                text = keep(_prose(rng))
                blocks.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>"]).format(text))
            elif shape < 0.8:
                blocks.append(f"<h2>{keep(_words(rng, rng.randint(1, 6)))}</h2>")
            elif shape < 0.88:
                blocks.append("<ul>" + "".join(f"<li>{keep(_words(rng, rng.randint(1, 9)))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif shape < 0.93:
                blocks.append(f"<blockquote><p>{keep(_prose(rng))}</p></blockquote>")
            elif shape < 0.96:
                blocks.append(_boilerplate(rng, rng.choice(["ad", "share", "form"])))
            else:
                blocks.append("<table><tr>" + "".join(f"<td>{keep(_words(rng, 2))}</td>" for _ in range(3)) + "</tr></table>")
        if rng.random() < 0.1:
            blocks = blocks[1:] or blocks
        if not bare and rng.random() < 0.1:
            blocks.append(f"<footer>{_words(rng, 5)}</footer>")
        tag = rng.choice(["article", "article", "main", "div", "section"])
        name = rng.choice(TOKEN_GROUPS[0].split())
        attribute = f' class="{name}{rng.choice(["", "-body", " x2"])}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
        body = f"<{tag}{attribute}>{''.join(blocks)}</{tag}>"
        if bare:
            body = "".join(blocks)
        wraps = ["<div>{}</div>", '<div id="wrap">{}</div>', "<main>{}</main>", f'<div class="{rng.choice(TOKEN_GROUPS[0].split())}">{{}}</div>']
        for wrap in rng.sample(wraps, rng.choice([0, 0, 1, 2])):
            body = wrap.format(body + "".join(_boilerplate(rng, k) for k in ("share", "aside", "comments", "ad") if rng.random() < 0.3))
        before = [_boilerplate(rng, k) for k in ("notice", "header", "nav", "ad") if rng.random() < 0.5]
        after = [_boilerplate(rng, k) for k in ("share", "comments", "aside", "form", "ad", "footer") if rng.random() < 0.5]
        yield f"<html><head><title>{title}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", main


def train(n_pages: int = 800, n_trees: int = 60, depth: int = 4) -> BoostedTrees:
    pages, labels = [], []
    for source, main in training_pages(n_pages):
        page = Page(source)
        holds = [t in main for t in page.text]
        for i in range(len(holds) - 1, 0, -1):
            holds[page.parent[i]] |= holds[i]
        pages.append(page)
        labels += holds
    return BoostedTrees(n_trees, depth).fit(features(pages), np.array(labels, float))


def extract(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    scores = model.score(features(pages)).tolist()
    out, at = [], 0
    for page in pages:
        n = len(page.parent)
        label = decode(page, scores[at : at + n])
        at += n
        out.append("\n".join(t for t, ok in zip(page.text, label, strict=True) if ok and t))
    return out


def main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, n_pages: int = 800, n_trees: int = 60) -> DataFrame:
    """The columns ``keep`` of every row of ``pages`` with its main text in ``text``."""
    model = train(n_pages, n_trees)
    keep = [c for c in keep or [] if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in by_bytes(batch.column(len(keep)), SLICE_BYTES):
                part = batch.slice(at, n)
                text = pa.array(extract(part.column(len(keep)).to_pylist(), model), pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], text], names=[*keep, "text"])

    fields = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep], "text string"])
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("__html")).mapInArrow(run, fields)
