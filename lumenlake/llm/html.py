"""Main text of web pages, with paths that the pages of a host agree on.

Each page is parsed into containers and text blocks.  Navigation, headers and
footers of the page, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out by element, role, class or id.  An element marked by
words, or a form, stays if it holds the article or, without one, most of the text;
all of them stay if nothing else is left.  Inside an article ids say nothing, as they
are made from headings, and only words that cannot belong to its text count.

The page's own choice is the lowest container outside of which no text remains, so
however short a lead, an end or a list of links is, it stays with the body.  A page
with just one ``main`` has its main text there, as the element says.  The path of
elements and classes to the choice, with digits made alike, is a vote for its host.
Votes are grouped counts, so a host of any size is a few rows per task.  Pages are then
extracted again with the paths their host agreed on: a container on the way to one of
them is content on that host, and stays also on pages where words or its share of the
text would have it left out.  An agreed path never drops text; pages of another
template keep their own choice.

Character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by one space.  Nulls count as empty pages and
give an empty text; a null address is a host of its own name ''.  Ids may be
null or repeat; every input row gives one row.  Equal votes rank by path.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import per_text, text_or_empty
from lumenlake.scratch import store

#: A path is agreed on from so many votes and this share of its host's pages.
LEAST_VOTES = 2
LEAST_SHARE = 0.1
PATH_DEPTH = 12

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button select textarea input label "
    "iframe object embed svg canvas map dialog menu audio video xmp noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text rather than other blocks; they are no containers.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr ul ol dl table".split())
#: Starting one of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
#: Starting the key ends an open element of the values, up to the listed parents.
ENDS_SIBLING = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}
ENDS_SIBLING = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS_SIBLING.items()}
#: Whole values of class, id or role that mark something other than the article; also
#: joined with each other and with words of :data:`PLACE` only, as in ``site-footer``.
NOISE = frozenset(
    "ad ads adv advert advertisement adverts adbox adslot banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent disqus footer gdpr login masthead menu menubar modal nav navbar navigation navigate "
    "newsletter notice notices overlay pager pagination paywall popup popular promo promotion recommended related "
    "reply replies respond rss share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags "
    "toolbar toc widget widgets contentinfo complementary search alert".split()
)
#: Words that inside an article may belong to its text.
AMBIGUOUS = frozenset(
    "alert notice notices login masthead banner overlay popular recommended related reply replies respond search skip "
    "tags toc complementary contentinfo".split()
)
#: Page headers only: inside an article the same words belong to it.
OUTER_NOISE = frozenset("header head top".split())
ANY_NOISE = NOISE | OUTER_NOISE
PLACE = frozenset(
    "area bar block bottom box container global inner left list main outer page primary right secondary section site "
    "wrap wrapper".split()
)
#: Reader comments are left out however long they are.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Others with over this share of the page's text outside of links stay, if no article is elsewhere.
MOST = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)"


class Page:
    """Elements by number (parents come first) and text blocks in page order."""

    def __init__(self, text: str, paths: list[str] | None = None) -> None:
        self._parse(text, frozenset())
        if self.marked and (spared := self._spared() | self._agreed(paths or [])):
            self._parse(text, spared)
        if not self.blocks and self.marked:
            self._parse(text, frozenset(self.marked))

    def _parse(self, text: str, spared: frozenset[int]) -> None:
        self.tag, self.label, self.parent, self.dropped, self.depth = ["#page"], [""], [-1], [False], [0]
        self.blocks: list[tuple[int, str]] = []  # container, text
        self.marked: dict[int, bool] = {}  # forms and elements marked by words; whether as comments
        self.sure = [False]  # dropped whatever the words say
        self.unlinked = [0]  # characters outside of links, also in marked elements
        stack = [0]
        opened: dict[str, int] = {}
        parts: list[str] = []
        containers = [0]  # those on the stack

        def flush() -> None:
            if parts:
                block = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if block:
                    self.blocks.append((containers[-1], block))

        def leave(to: int) -> None:
            """Close elements down to the stack length ``to``."""
            if containers[-1] >= stack[to]:
                flush()
            while containers[-1] >= stack[to]:
                containers.pop()
            for e in stack[to:]:
                opened[self.tag[e]] -= 1
            del stack[to:]

        def add(piece: str) -> None:
            if piece and not self.sure[stack[-1]] and not opened.get("a"):
                self.unlinked[stack[-1]] += len(piece.strip())
            if piece and not self.dropped[stack[-1]]:
                parts.append(piece)

        at = 0
        while (found := _TOKEN.search(text, at)) is not None:
            add(text[at:found.start()])
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                if found[0].startswith("<![CDATA["):
                    add(entities.escape(found[0][9:].removesuffix("]]>")))
                continue
            tag = name.lower()
            if found[1] or found[4]:
                if opened.get(tag):
                    to = len(stack) - 1
                    while self.tag[stack[to]] != tag:
                        to -= 1
                    leave(to)
                elif tag == "br" or tag == "p":
                    flush()
                continue
            if tag in ("br", "hr"):
                flush()
            if tag in VOID:
                continue
            attributes = found[3] or found[6] or ""
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
                at = end.end() if end else len(text)
                continue
            if tag in ENDS_P and opened.get("p"):
                to = len(stack) - 1
                while self.tag[stack[to]] != "p":
                    to -= 1
                leave(to)
            if tag in ENDS_SIBLING:
                siblings, parents = ENDS_SIBLING[tag]
                to = len(stack) - 1
                while to > 0 and self.tag[stack[to]] not in parents and self.tag[stack[to]] not in siblings:
                    to -= 1
                if to > 0 and self.tag[stack[to]] in siblings:
                    leave(to)
            if tag not in INLINE:
                flush()
            above = stack[-1]
            label, noise, words = self._label(tag, attributes, bool(opened.get("article") or opened.get("main")))
            number = len(self.tag)
            if words:
                self.marked[number] = words == "comments"
            self.tag.append(tag)
            self.label.append(label)
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            self.sure.append(self.sure[above] or noise)
            self.unlinked.append(0)
            self.dropped.append(self.dropped[above] or noise or (words != "" and number not in spared))
            stack.append(len(self.tag) - 1)
            opened[tag] = opened.get(tag, 0) + 1
            if tag not in INLINE:
                containers.append(stack[-1])
        add(text[at:])
        flush()

    def _spared(self) -> frozenset[int]:
        """Marked elements that stay: those with most of the page's text or with an article,
        unless there is an article outside of marked elements."""
        n = len(self.tag)
        below = self.unlinked.copy()
        article = [t in ("article", "main") for t in self.tag]
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            below[up] += below[e]
            article[up] = article[up] or (article[e] and below[e] > 0)
        outside = any(
            t in ("article", "main") and below[e] and not self.dropped[e] for e, t in enumerate(self.tag)
        )
        return frozenset(
            e for e, comments in self.marked.items()
            if not outside and not comments and (article[e] or below[e] > MOST * below[0])
        )

    def _agreed(self, paths: list[str]) -> frozenset[int]:
        """Marked elements on the way to a container that the host agreed on; comments never are."""
        return frozenset(
            e for e, comments in self.marked.items()
            if not comments and any(f"{p}>".startswith(f"{self.path(e)}>") for p in paths)
        )

    @staticmethod
    def _label(tag: str, attributes: str, inside: bool) -> tuple[str, bool, str]:
        """Label, whether the element is dropped for sure, and what its words or its being a
        form mark it as: ``comments``, ``noise`` or nothing."""
        noise = tag in DROPPED or (tag == "header" and not inside)
        marks = "noise" if tag == "form" else ""
        classes: list[str] = []
        if attributes and not attributes.isspace():
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "hidden" or (key == "aria-hidden" and value == "true"):
                    noise = True
                elif key == "style":
                    noise = noise or re.search(r"display\s*:\s*none", value) is not None
                else:
                    # Ids inside an article, and of headings anywhere, are made from its text.
                    if tag not in ("html", "body", "article", "main") and not (key == "id" and (inside or tag in HEADINGS)):
                        for token in value.split():
                            words = set(_PART.findall(token))
                            telling = words & (NOISE - AMBIGUOUS) if inside else words & ANY_NOISE
                            if telling and words <= telling | PLACE:
                                marks = "comments" if words & COMMENTS else marks or "noise"
                    if key == "class":
                        classes = sorted(_DIGITS.sub("#", c) for c in value.split())[:2]
        return ".".join([tag, *classes]), noise, marks

    def path(self, element: int) -> str:
        """Labels from the outermost element; deep paths keep their lowest part."""
        labels = []
        while element > 0 and len(labels) < PATH_DEPTH:
            labels.append(self.label[element])
            element = self.parent[element]
        return ">".join(reversed(labels))

    def choice(self) -> int:
        """The lowest container outside of which no text remains."""
        n = len(self.tag)
        weight = [0] * n
        for element, block in self.blocks:
            weight[element] += len(block)
        for e in range(n - 1, 0, -1):
            weight[self.parent[e]] += weight[e]
        children: dict[int, int] = {}
        nearest = [0] * n  # block around the element; inline parents are passed through
        for e in range(1, n):
            up = self.parent[e]
            if self.tag[up] in INLINE:
                up = nearest[up]
            nearest[e] = up
            if self.tag[e] not in TEXTUAL and self.tag[e] not in INLINE and weight[e] == weight[up]:
                children[up] = e
        mains = [e for e in range(1, n) if self.tag[e] == "main" and weight[e]]
        at = mains[0] if len(mains) == 1 else 0
        while weight[at] and (child := children.get(at)) is not None:
            if self.tag[at] in ("article", "main") and self.tag[child] != "article":
                break
            at = child
        return at

    def text(self, root: int) -> str:
        inside = [False] * len(self.tag)
        inside[root] = True
        for e in range(1, len(self.tag)):
            inside[e] = inside[e] or inside[self.parent[e]]
        return " ".join(block for element, block in self.blocks if inside[element])


def extract(html: str, paths: list[str]) -> tuple[str, str]:
    """Main text and the path it was taken from, given the paths the host agreed on."""
    page = Page(html, paths)
    root = page.choice()
    return page.text(root), page.path(root)


def host_paths(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``host, paths``: the paths that a host's pages agree on, most votes first."""

    def make() -> Callable[[str], tuple]:
        def of(html: str) -> tuple:
            page = Page(html)
            return (page.path(page.choice()) if page.blocks else "",)

        return of

    host = F.lower(F.regexp_extract(F.coalesce(url_column, F.lit("")), _HOST, 1))
    votes = per_text(pages.withColumn("_host", host), url_column, text_or_empty(html_column), "path string", make, keep="_host")
    counted = store(votes.groupBy(F.col("_host").alias("host"), "path").agg(F.count("*").alias("votes")), "votes")
    total = counted.groupBy("host").agg(F.sum("votes").alias("pages"))
    agreed = counted.join(total, "host").filter(
        (F.col("path") != "") & (F.col("votes") >= LEAST_VOTES) & (F.col("votes") >= LEAST_SHARE * F.col("pages"))
    )
    # At most 1 / LEAST_SHARE paths per host.
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return agreed.groupBy("host").agg(F.transform(ranked, lambda s: s["path"]).alias("paths"))


def main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars, path``."""
    agreed = store(host_paths(pages, url_column, html_column), "host-paths")
    host = F.lower(F.regexp_extract(F.coalesce(url_column, F.lit("")), _HOST, 1))
    rows = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"),
        text_or_empty(html_column).alias("html"), host.alias("host"),
    )
    joined = rows.join(agreed, "host", "left").select("page_id", "url", "html", "paths")
    id_type = joined.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                extract(html, paths or [])
                for html, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            text = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array(list(map(len, text)), pa.int64()), pa.array([p for _, p in found], pa.string())],
                ["page_id", "url", "text", "n_chars", "path"],
            )

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long, path string")
