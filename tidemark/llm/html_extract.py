"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. Every block of text belongs to a root-to-leaf
tag path (tag names with their classes). Per path the characters outside links, the punctuation
marks, the share of link text and the number of blocks are summed, and the share of the words of
the page's title that it holds. The density of a path is its characters a block, raised by
punctuation and lowered by links. The path tree is smoothed both ways: a container collects what
its paths hold, and a path takes the mean of its own density and those of the containers above it.

From the root the content is found by going down while one child holds at least ``SHARE`` of what
its parent holds; where that ends is the content container. A path inside it is kept while its
smoothed density is at least ``KEEP`` of the best one. What the markup says of an element, by its
tag or by words of its class, id or role, is one more factor of the density (``MARKED``): it
decides only where text that looks alike is told apart, such as reader comments. An article or
main element clears the mark of what lies around it, and so does a container that holds most of
the page, unless it is named as comments or adverts.

Each page is judged on its own, so pages are a map over the table: no shuffle, any skew of
hosts is harmless, and a lost task re-reads its rows. Time and memory are linear in the page.

Defined results: null or empty html, and a page without text, give an empty text; markup cut off
at the end of the page is read as far as it goes (an unfinished tag or comment is dropped); a
quote that is never closed ends with its tag; unknown character references stay as they are; the
raw elements below have no text, math, svg and object keep theirs; very deep and very long pages
are read whole; repeated rows are kept; empty table, empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Share of a container's score that one child must hold to be entered, and of the page's for a mark to be cleared.
SHARE = 0.5
#: Part of the best smoothed density that a path must reach, and the factor of what the markup names as furniture.
KEEP, MARKED = 0.1, 0.08
#: Characters that a path counts more if it holds the whole title.
TITLE = 400

OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BORDER = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
WORD = re.compile(r"[a-z0-9]+")

# Fixed values of HTML: elements without content, with raw text, and that don't break a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub mfrac msqrt svg object".split())
#: Opening one of these ends an open paragraph, as in HTML.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An element beyond one of these is not ended by what opens inside.
SCOPES = ("table", "ul", "ol", "dl", "div", "section", "article", "main", "body")
# What the markup names as furniture: elements, and words in class, id or role.
FURNITURE_TAGS = frozenset("header footer aside form".split())
NEVER_CONTENT_TAGS = frozenset("nav menu dialog button select head".split())
FURNITURE_WORDS = frozenset(
    "banner promo menu menubar nav navbar navigation breadcrumb breadcrumbs header footer "
    "sidebar aside widget cookie cookies consent notice notices alert popup modal newsletter subscribe signup login form search share sharing "
    "social toolbar pager pagination copyright contentinfo complementary".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
#: A class such as with-sidebar tells what an element has, not what it is.
HAS = frozenset("with has no without".split())
#: Words whose mark stays, whatever the element holds: reader comments, teasers and adverts.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement sponsor sponsored comment comments disqus reply replies respond related recommended teaser".split())
#: Words that name a part of such an element and say nothing of what it holds.
PARTS = frozenset("list section area box item items block container wrapper wrap inner outer body content text title heading meta author avatar date post posts article articles story stories news link links slot unit zone space count form thread tree card cards grid row top bottom left right main more block the".split())


class Page:
    """The tag paths of a page as a tree, parents before children, and its blocks in order."""

    def __init__(self, page: str):
        self.parent, self.label, self.mark = [-1], [""], [0]
        self.blocks: list[tuple[int, str, int]] = []  # path, text, characters inside links
        self.title: set[str] = set()
        self._nodes: dict[tuple[int, str, int], int] = {}
        self._read(page)

    def _node(self, parent: int, label: str, mark: int) -> int:
        at = self._nodes.setdefault((parent, label, mark), len(self.parent))
        if at == len(self.parent):
            self.parent.append(parent)
            self.label.append(label)
            self.mark.append(mark)
        return at

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # tag, path
        open_at: dict[str, list[int]] = defaultdict(list)  # tag: its places in the stack
        blocks_open = [0]  # open elements that break a block
        parts: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1][1] if stack else 0, text, linked))
                parts.clear()
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                parts.append(piece)
                if open_at["a"]:
                    linked += len(piece.strip())

        def close(k: int) -> None:
            """Closes the elements from place k on; the text so far belongs to the innermost."""
            if any(tag not in INLINE for tag, _ in stack[k:]):
                flush()
            for tag, _ in reversed(stack[k:]):
                open_at[tag].pop()
            del stack[k:]

        at, n = 0, len(page)
        last = {q: page.rfind(q) for q in "\"'"}
        while at < n:
            m = OPENS.search(page, at)
            if not m:
                add(page[at:])
                break
            add(page[at : m.start()])
            if m.group() == "<!--":
                end = page.find("-->", m.end())
                at = n if end < 0 else end + 3
                continue
            if m.group() in ("<!", "<?"):
                end = page.find(">", m.end())
                at = n if end < 0 else end + 1
                continue
            closing = page[m.start() + 1] == "/"
            name = NAME.match(page, m.end() - 1)
            at = name.end()
            while True:  # the tag's end, outside quotes
                b = BORDER.search(page, at)
                if not b:
                    at = -1
                    break
                at = b.end()
                if b.group() == ">":
                    break
                if last[b.group()] >= at:  # closed somewhere
                    at = page.find(b.group(), at) + 1
            if at < 0:  # the page ends inside the tag
                break
            tag, rest = name.group().lower(), page[name.end() : at - 1]
            if closing:
                if tag in RAW:
                    continue
                if open_at[tag]:
                    close(open_at[tag][-1])
                elif tag not in INLINE:
                    flush()
                continue
            if tag in RAW:
                if tag not in INLINE:
                    flush()
                if not rest.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                    if tag == "title" and not self.title and not open_at["svg"]:
                        self.title = set(html.unescape(page[at : end.start() if end else n]).lower().split())
                    if not end:
                        break
                    at = end.start()
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
                over = ("p",) if tag in ENDS_P else ENDS_SAME.get(tag, ())
                k = max((open_at[t][-1] for t in over if open_at[t]), default=-1)
                if k >= 0 and k >= max((open_at[t][-1] for t in SCOPES if open_at[t]), default=-1):
                    close(k)
            if tag in VOID:
                continue
            path = stack[-1][1] if stack else 0
            if tag not in INLINE:
                path = self._node(path, *self._named(tag, rest, bool(open_at["article"] or open_at["main"])))
            open_at[tag].append(len(stack))
            stack.append((tag, path))
        flush()

    @staticmethod
    def _named(tag: str, rest: str, in_content: bool) -> tuple[str, int]:
        """Label of an element and what the markup says: 1 furniture, 2 menus, comments or adverts, -1 content."""
        names = [WORD.findall(name) for _, v in ATTRIBUTE.findall(rest) for name in v.strip("\"'").lower().split()] if rest else []
        words = [w for name in names if name and name[0] not in HAS for w in name]
        # inside named content a name that says more, such as related-work, is no mark
        outside = any(NOT_CONTENT.intersection(name) and (not in_content or all(w in NOT_CONTENT or w in FURNITURE_WORDS or w in PARTS for w in name)) for name in names if name and name[0] not in HAS)
        if tag in NEVER_CONTENT_TAGS or outside:
            mark = 2
        elif tag in CONTENT_TAGS:
            mark = -1
        elif tag in ("html", "body"):
            mark = 0
        elif tag in FURNITURE_TAGS and not (tag == "header" and in_content):
            mark = 1
        else:  # the head of an article belongs to it
            mark = int(not (FURNITURE_WORDS - {"header"} if in_content else FURNITURE_WORDS).isdisjoint(words))
        return ".".join([tag, *words]), mark


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    found = Page(page or "")
    if not found.blocks:
        return ""
    parent, n = found.parent, len(found.parent)
    chars, marks, links, count, held_title = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    words: dict[int, set[str]] = defaultdict(set)
    for at, text, linked in found.blocks:
        chars[at] += len(text)
        marks[at] += len(PUNCTUATION.findall(text))
        links[at] += min(linked, len(text))
        count[at] += 1
        if found.title:
            words[at] |= found.title.intersection(text.lower().split())
    # what a path holds: blocks times density, and the title's share
    score = [0.0] * n
    for i in range(n):
        if count[i]:
            score[i], held_title[i] = density(chars[i], marks[i], links[i], count[i]), len(words[i]) / len(found.title) if words[i] else 0.0
    plain = [c * s for c, s in zip(count, score, strict=True)]
    total_blocks = list(count)
    whole = [p + TITLE * t * (1 - l / max(1, c)) for p, t, l, c in zip(plain, held_title, links, chars, strict=True)]
    own = list(whole)
    for i in range(n - 1, 0, -1):  # containers collect, children before parents
        for held in (plain, whole, total_blocks):
            held[parent[i]] += held[i]
    # a mark is cleared where it lies around most of the page
    said = [0 if m == 1 and w > SHARE * whole[0] else m for m, w in zip(found.mark, whole, strict=True)]
    factor = [1.0] * n
    for i in range(1, n):
        factor[i] = marked(said[i], factor[parent[i]])
    held = [w * f for w, f in zip(own, factor, strict=True)]
    for i in range(n - 1, 0, -1):
        held[parent[i]] += held[i]
    children: dict[int, list[int]] = defaultdict(list)
    for i in range(1, n):
        children[parent[i]].append(i)
    top = 0
    while inner := [i for i in children[top] if i in children]:
        best = max(inner, key=held.__getitem__)
        if held[best] <= SHARE * held[top] or held[best] <= 0:
            break
        top = best
    # smoothing from the container down: mean of the densities from it to the path
    inside, depth, mean = [False] * n, [0] * n, [0.0] * n
    inside[top], below = True, [1.0] * n
    for i in range(top, n):
        if i != top and not inside[parent[i]]:
            continue
        level = (plain[i] / total_blocks[i]) ** 0.5 if total_blocks[i] else 0.0
        up = 0 if i == top else depth[parent[i]]
        inside[i], depth[i] = True, up + 1
        mean[i] = (level + (mean[parent[i]] * up if up else 0.0)) / (up + 1)
        below[i] = 1.0 if i == top and said[i] < 2 else marked(said[i], below[parent[i]])
    best = max((mean[i] for i in range(top, n) if inside[i] and count[i] and below[i] == 1.0), default=0.0)
    # nothing but links and menus: what the markup doesn't name stays
    kept = [inside[i] and (mean[i] * below[i] >= KEEP * best if best else below[i] == 1.0) for i in range(n)]
    return "\n".join(text for at, text, _ in found.blocks if kept[at])


def density(chars: int, marks: int, links: int, blocks: int) -> float:
    """Fused ratios of a path: characters outside links a block, raised by punctuation, lowered by links."""
    a_block = marks / blocks
    return (chars - links) / blocks * (1 + a_block / (1 + a_block)) * (1 - links / chars)


def marked(mark: int, above: float) -> float:
    """The markup's factor of a path, from that of the path above it."""
    return 1.0 if mark < 0 else MARKED if mark > 0 else above


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars."""

    def run(batches):
        for b in slices(batches):
            texts = [main_text(h.as_py()) for h in b[html_col]]
            yield pa.RecordBatch.from_arrays([b[id_col], b[url_col], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {types[id_col]}, {url_col} {types[url_col]}, text string, n_chars long")


def op9_tag_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
