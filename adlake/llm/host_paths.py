"""Main text of web pages, found by what the pages of a host have in common.

Each page proposes the container that holds its article. A host's pages vote on the
generalised paths of those containers, and each page is extracted by the path most
voted for that it has.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlake.llm.common import ship, small_batches, stored

#: A path is one of a host's if this share of its pages votes for it, or if it leads.
MIN_VOTES = 0.2

#: A container is entered while one child holds this share of its text.
HOLDS = 0.7

#: Element names by the part they play.
CONTAINERS = frozenset(
    "html body div section article main aside header footer nav form figure blockquote "
    "details dialog menu fieldset center hgroup search".split()
)
LEAVES = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre "
    "address figcaption summary legend hr".split()
)
UNREAD = "script style noscript template iframe svg math canvas object audio video select button textarea title"
FURNITURE = frozenset("nav aside footer form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())

#: Words in class names and ids that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
    "topbar comment comments disqus respond reply cookie cookies consent gdpr notice "
    "notification notifications alert popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended recommendations widget toolbar "
    "pagination pager login signup search form skip".split()
)

#: Closed by the start of an element that can't be inside them.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "tr": frozenset(["tr", "td", "th"]),
}

#: A tag has at most this many pieces in and between quotes; a longer one opens nothing.
#: Without a bound, every tag of a page with an unclosed quote is looked for to its end.
PIECES = 400

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:{UNREAD.replace(' ', '|')})(?:/|\s[^>]*+(?<=[\s\"']/))>"
    rf"|<({UNREAD.replace(' ', '|')})(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){{0,{PIECES}}}+)>"
    r"|<[!?/a-zA-Z][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _unclosed(match: re.Match) -> bool:
    """Whether the text from ``match`` on is a comment or an unread element without end."""
    if match[1]:
        return not re.search(rf"</{match[1]}\s*>\Z", match[0], re.I)
    return match[0].startswith("<!--") and not match[0].endswith("-->")


class Page:
    """Containers and text blocks of one page, in page order.

    Time and memory are linear in the page, however deep its containers are and whatever
    it leaves open: a path is a number for the path above it and the last step.
    """

    def __init__(self, text: str):
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps = [(-1, "")]  # of each path, the path above it and its last step
        self.paths = [0]  # of each container
        self.parents = [-1]
        self.inside = [False]
        #: What may be furniture: the one around each, whether it is for certain.
        self.around = [0]
        self.certain = [False]
        self.marked = [0]  # the innermost one around each container
        self.articles: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []
        found = self._parse(text)
        furniture = self._furniture(found)
        self.blocks = [(node, block, linked) for node, block, linked, mark in found if not furniture[mark]]

    def _parse(self, text: str) -> list[tuple[int, str, int, int]]:
        stack: list[tuple[str, int, int]] = [("", 0, 0)]
        opened: Counter[str] = Counter()
        found: list[tuple[int, str, int, int]] = []
        parts: list[str] = []
        linked = [0, 0]  # open links, and characters in links

        def add(piece: str) -> None:
            if piece:
                parts.append(piece)
                if linked[0]:
                    linked[1] += len(piece)

        def flush() -> None:
            _, node, mark = stack[-1]
            if parts and not self.certain[mark]:
                block = " ".join(entities.unescape("".join(parts)).split())
                if block:
                    found.append((node, block, min(linked[1], len(block)), mark))
            parts.clear()
            linked[1] = 0

        def close(depth: int) -> None:
            flush()
            opened.subtract(name for name, _, _ in stack[depth:])
            del stack[depth:]
            linked[0] = 0

        at, last = 0, text.rfind(">") + 1  # no tag ends after that
        match = None
        for match in _TOKEN.finditer(text, 0, last):
            add(text[at : match.start()])
            at = match.end()
            name = (match[3] or "").lower()
            if name == "a":
                linked[0] = 0 if match[2] else 1
            elif name == "br":
                parts.append(" ")
            if name not in CONTAINERS and name not in LEAVES:
                continue
            if match[2]:
                if opened[name]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
                continue
            ended = ENDED_BY.get(name, frozenset())
            depth = len(stack)
            while depth > 1 and (
                stack[depth - 1][0] in ended
                or stack[depth - 1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "hr")
            ):
                depth -= 1
            close(depth)
            stack.append(self._open(name, match[4], stack[-1]))
            opened[name] += 1
        if match is None or match.end() < last or not _unclosed(match):
            add(text[at:].partition("<!--")[0])
        flush()
        return found

    def _furniture(self, found: list[tuple[int, str, int, int]]) -> list[bool]:
        """Of each that may be furniture, whether it is: not if no article is outside of
        all of them, and it holds the page's longest one or most of the unlinked text."""
        top = list(range(len(self.paths)))
        article = set(self.articles)
        for node in range(1, len(top)):
            if node not in article:
                top[node] = top[self.parents[node]]
        weight, held = [0] * len(self.around), dict.fromkeys(self.articles, 0)
        for node, block, linked, mark in found:
            weight[mark] += len(block) - linked
            if top[node] in held:
                if not mark:
                    return [False, *[True] * (len(weight) - 1)]
                if mark == self.marked[top[node]]:
                    held[top[node]] += len(block) - linked
        for mark in range(len(weight) - 1, 0, -1):
            weight[self.around[mark]] += weight[mark]
        furniture = [
            mark > 0 and (self.certain[mark] or not weight[mark] or weight[mark] < HOLDS * weight[0])
            for mark in range(len(weight))
        ]
        best = max(held, key=lambda node: (held[node], -node), default=0)
        mark = self.marked[best] if held.get(best) else 0
        while mark:
            furniture[mark] = False
            mark = self.around[mark]
        for mark in range(1, len(weight)):
            furniture[mark] = furniture[mark] or furniture[self.around[mark]]
        return furniture

    def _open(self, name: str, attributes: str, above: tuple[str, int, int]) -> tuple[str, int, int]:
        _, node, mark = above
        found = {
            key.lower(): a or b or c for key, a, b, c in _ATTRIBUTE.findall(attributes or "")
        }
        named = f"{found.get('class', '')} {found.get('id', '')}"
        marks = {word.lower() for word in _WORD.findall(named)} if named.strip() else set()
        in_article = self.inside[node]
        certain = name in FURNITURE - {"form"} or found.get("role", "").lower() in ROLES
        furniture = (
            certain
            or name == "form"
            or (not in_article and (name == "header" or "header" in marks))
            or not marks.isdisjoint(MARKS)
        )
        # What encloses the whole page, or is the article itself, isn't furniture.
        if name in ("html", "body", "article", "main") and not (
            name == "article" and not marks.isdisjoint(("comment", "comments", "reply", "ad", "ads"))
        ):
            furniture = False
        if furniture:
            self.around.append(mark)
            self.certain.append(certain or self.certain[mark])
            mark = len(self.around) - 1
        if name in CONTAINERS:
            kinds = {re.sub(r"\d+", "#", kind.lower()) for kind in found.get("class", "").split()}
            place = self.paths[node], ".".join([name, *sorted(kinds)]).replace(">", "")
            self.paths.append(self.numbers.setdefault(place, len(self.steps)))
            if self.paths[-1] == len(self.steps):
                self.steps.append(place)
            self.parents.append(node)
            self.inside.append(
                in_article or name in ("article", "main") or found.get("role", "").lower() == "main"
            )
            self.marked.append(mark)
            node = len(self.paths) - 1
            if self.inside[node] and not in_article and not furniture:
                self.articles.append(node)
        return name, node, mark

    def _path(self, node: int) -> str:
        path, steps = self.paths[node], []
        while path:
            path, step = self.steps[path]
            steps.append(step)
        return ">".join(reversed(steps))

    def _number(self, path: str) -> int | None:
        number: int | None = 0
        for step in path.split(">") if path else ():
            number = self.numbers.get((number, step))
            if number is None:
                return None
        return number

    def proposal(self) -> tuple[str, int] | None:
        """Path of the container that seems to hold the article, and its characters
        outside links."""
        weight = [0] * len(self.paths)
        for node, block, linked in self.blocks:
            weight[node] += len(block) - linked
        for node in range(len(weight) - 1, 0, -1):
            weight[self.parents[node]] += weight[node]
        if not weight[0]:
            return None
        said = [
            node
            for node in range(1, len(weight))
            if self.inside[node] and not self.inside[self.parents[node]] and weight[node]
        ]
        if said:
            best = max(said, key=lambda node: (weight[node], -node))
            return self._path(best), weight[best]
        best = 0
        for node in range(1, len(weight)):  # what a container holds comes after it
            if self.parents[node] == best and weight[node] >= HOLDS * weight[best]:
                best = node
        return self._path(best), weight[best]

    def text(self, paths: list[str]) -> str:
        """Blocks of the containers at the first of ``paths`` that the page has text at."""
        for path in paths:
            number = self._number(path)
            if number is None:
                continue
            chosen = [False] * len(self.paths)
            for node in range(len(self.paths)):
                above = node > 0 and chosen[self.parents[node]]
                chosen[node] = above or self.paths[node] == number
            found = [block for node, block, _ in self.blocks if chosen[node]]
            if found:
                return "\n".join(found)
        return ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1):
        rows = []
        for url, html in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            proposal = Page(html).proposal() if html else None
            if proposal:
                rows.append((host_of(url), *proposal))
        columns = zip(*rows, strict=True) if rows else [()] * 3
        kinds = (pa.string(), pa.string(), pa.int64())
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "path", "chars"])


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([host_of(url) for url in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], ["id", "url", "html", "host"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 2):
        texts = []
        for html, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            page = Page(html or "")
            own = page.proposal()
            texts.append(page.text([*(paths or []), *([own[0]] if own else [])]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"]
        )


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host`` and its ``paths``, those with most votes first, stored."""
    ship(pages.sparkSession)
    proposed = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(
        _propose, "host string, path string, chars long"
    )
    votes = proposed.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars")
    )
    of_host = Window.partitionBy("host")
    ranked = votes.select(
        "*",
        F.row_number().over(of_host.orderBy(F.desc("votes"), F.desc("chars"), "path")).alias("rank"),
        F.sum("votes").over(of_host).alias("cast"),
    ).where((F.col("rank") == 1) | (F.col("votes") >= MIN_VOTES * F.col("cast")))
    return stored(
        ranked.groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("ranked"))
        .select("host", F.col("ranked.path").alias("paths")),
        "paths",
    )


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id``, ``url`` and the main ``text`` of every row of ``pages``.

    A null or empty page, or one without an article, has empty text; a null or unreadable
    url belongs to a host of its own, the empty one; null ids and repeated rows are kept;
    an empty table gives no rows. Whole pages are read, and nothing nested is too deep:
    work and memory are linear in a page's length. A host's votes are counted before
    they are shuffled, and at most ``1 / MIN_VOTES`` paths of a host are kept, so a host
    with a third of all pages is no hot group; Spark broadcasts the table of paths where
    its size allows and splits the join's hot hosts where it doesn't.
    """
    winners = winning_paths(pages, url, html)
    placed = pages.select(
        F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html")
    ).mapInArrow(_hosts, "id long, url string, html string, host string")
    joined = placed.join(winners, "host", "left").select("id", "url", "html", "paths")
    return joined.mapInArrow(_extract, "id long, url string, text string")
