"""Main text of web pages by the container paths that the pages of a host agree on."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, map_slices

# Elements and class words of HTML.
RAW = "script|style|noscript|template|textarea|svg|iframe|object|select|title"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+(?<=/)>"
    rf"|<({RAW})\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>.*?(?:</\1\s*[^>]*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
CONTAINERS = frozenset(
    "body main article section div td blockquote center dd figure details aside nav header footer "
    "form fieldset dialog menu ul ol table".split()
)
#: Blocks that hold others, and blocks and inline elements that end with the next block.
PARTS = frozenset("li pre tr th dt dl address figcaption summary caption".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("span a b i em strong small ins font label mark".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li pre tr th dt dl hr address figcaption summary caption head html".split()
)
DROPPED = frozenset("nav header footer aside fieldset dialog menu button head".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager sidebar "
    "aside rail widget header masthead footer cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended comment comments respond replies disqus thread threads discussion "
    "complementary contentinfo".split()
)
#: Parts that a class on the list may have before and after its words.
BEFORE = frozenset("site main page global top bottom left right primary secondary".split())
AFTER = DROPPED_WORDS | frozenset(
    "area bar block body box buttons container content form inner item items left links list meta "
    "right section slot text unit wrap wrapper".split()
)
#: Talk may well be longer than its article.
TALK_WORDS = frozenset(
    "comment comments respond replies disqus social related thread threads discussion".split()
)
#: Parts that a class may have before such words.
TALK_BEFORE = frozenset("user users reader readers post entry article story blog".split())
#: Share of a page's useful text up to which other pages of the host decide on a part, and from
#: which the only article or main element of a page speaks against the columns beside it.
LEFT_SHARE, ARTICLE_SHARE = 0.1, 0.1
#: Least shares of a page's text outside links by which a form or a container with a word of the
#: list, or one of talk, counts as the page itself.
PAGE_SHARE, TALK_SHARE = 0.5, 0.9
#: A class with one of these besides `header` is the head of the article, not of the page.
ARTICLE_WORDS = frozenset("article entry post story content title".split())
ATTRIBUTE = re.compile(
    r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE
)
#: Share of the useful text that an inner container must hold to stand for the best one.
NEARLY_ALL = 0.97
#: Attributes whose values say nothing about the element.
PLAIN = re.compile(r"\b(?:title|alt|href|src|content|name|data-[\w-]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*\"?true", re.I)


def _unwanted(name: str) -> set[str]:
    """Words of the list that a class, id or role consists of, but for parts that say where or what."""
    parts = [part for part in re.split(r"[^a-z]+", name) if part]
    if len(parts) > 1 and (parts[0] in BEFORE or (parts[0] in TALK_BEFORE and parts[1] in TALK_WORDS)):
        del parts[0]
    if parts and parts[0] in DROPPED_WORDS and AFTER.issuperset(parts):
        return DROPPED_WORDS.intersection(parts)
    return set()


def _marks(tag: str, attributes: str) -> tuple[str, bool, float]:
    """Step of the generalised path, whether the subtree is no article text, and up to which share.

    The share of the page's text up to which it is none for its words only is
    0 if there are no such words.
    """
    classes, unwanted, words = "", set(), set()
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            words.update(re.split(r"[^a-z]+", value))
            for one in value.split():
                unwanted |= _unwanted(one)
            if name.lower() == "class":
                classes = ".".join(sorted(set(re.sub(r"\d+", "#", value).split())))
        if HIDDEN.search(PLAIN.sub("", attributes)):
            return tag, True, 0
    if "header" in unwanted and words & ARTICLE_WORDS:
        unwanted = unwanted - {"header"}
    share = 0.0
    if tag != "body" and unwanted:
        share = TALK_SHARE if unwanted & TALK_WORDS else PAGE_SHARE
    elif tag == "form":
        share = PAGE_SHARE
    return f"{tag}.{classes}" if classes else tag, tag in DROPPED, share


def parsed(html: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, bool]]]:
    """Containers as (path, first block, end) and blocks as (text, link characters, dropped).

    Blocks are in page order. A container that is not closed ends with the one
    around it; an article or main element ends whatever dropped part is open.
    A header inside an article belongs to it. A form, or a container dropped
    for a word, is kept if it is around an article or main element or holds
    most of the page's text outside links, or if nothing were left. Paragraphs,
    list items and the like are containers if they have a word of the list;
    inline elements with one are left out of their block, unless nothing else
    were left. Of a page with one article or main element, columns beside it
    are dropped.
    """
    found = _parsed(html, True)
    if not any(not block[2] for block in found[1]):
        found = _parsed(html, False)
    return found


def _parsed(html: str, skip_inline: bool) -> tuple[list, list]:
    containers: list[list] = [["", 0, 0]]
    blocks: list[list] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    doubtful: dict[int, float] = {}
    pieces: list[str] = []
    link_chars, in_link, at = 0, False, 0
    articles: list[int] = []
    around: set[int] = set()
    line_marks, skipped, depth_skipped = (False, 0.0), "", 0

    def close_block() -> None:
        nonlocal link_chars, line_marks, skipped
        dropped, share = line_marks
        line_marks, skipped = (False, 0.0), ""
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                if share:
                    containers.append([containers[stack[-1][1]][0] + ">line", len(blocks), len(blocks) + 1])
                    doubtful[len(containers) - 1] = share
                blocks.append([text, min(link_chars, len(text)), dropped or stack[-1][3]])
            pieces.clear()
            link_chars = 0

    for match in TOKEN.finditer(html):
        if match.start() > at and not skipped:
            piece = html[at : match.start()]
            piece = entities.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if in_link:
                link_chars += len(piece)
        at = match.end()
        tag = match[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), match[2]
        if tag == "a":
            in_link = not closing
        if tag in INLINE:
            if skipped == tag:
                depth_skipped += -1 if closing else 1
                if not depth_skipped:
                    skipped = ""
            elif skip_inline and not skipped and not closing and match[4]:
                _, dropped, share = _marks(tag, match[4])
                if dropped or share:
                    skipped, depth_skipped = tag, 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCKS or tag == "button":
            close_block()
            in_link = False
            if tag in LINES:
                if not closing and match[4]:
                    line_marks = _marks(tag, match[4])[1:]
                continue
            if tag in PARTS:
                while not closing and stack[-1][0] == tag:  # the one before was not closed
                    containers[stack.pop()[1]][2] = len(blocks)
                if not closing and not any(_marks(tag, match[4])[1:]):
                    continue
            elif tag not in CONTAINERS and tag not in DROPPED:
                continue
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        for _, number, _, _ in stack[depth:]:
                            containers[number][2] = len(blocks)
                        del stack[depth:]
                        break
                continue
            step, dropped, share = _marks(tag, match[4])
            if tag in ("article", "main") and not dropped and not share:
                while stack[-1][2]:
                    number = stack.pop()[1]
                    containers[number][2] = len(blocks)
                    if doubtful.get(number) == PAGE_SHARE:
                        del doubtful[number]  # it is around the article
                        around.add(number)
            if tag == "header" and any(name in ("article", "main") for name, *_ in stack):
                dropped, share = False, 0
            path = f"{containers[stack[-1][1]][0]}>{step}"
            containers.append([path, len(blocks), -1])
            if tag in ("article", "main"):
                articles.append(len(containers) - 1)
            if share:
                doubtful[len(containers) - 1] = share
            _, _, open_part, sure = stack[-1]
            stack.append((tag, len(containers) - 1, dropped or share > 0 or open_part, dropped or sure))
    if at < len(html):
        piece = html[at:]
        pieces.append(entities.unescape(piece) if "&" in piece else piece)
    close_block()
    for _, number, *_ in stack:
        containers[number][2] = len(blocks)
    if doubtful:
        _drop_doubtful(doubtful, containers, blocks)
    _drop_columns(articles, around, containers, blocks)
    return [tuple(container) for container in containers], [tuple(block) for block in blocks]


def _drop_columns(articles: list[int], around: set[int], containers: list, blocks: list) -> None:
    """Marks blocks of containers beside the only article, or else the only main element.

    An element inside another one is not counted. What stands right in a
    container around it, such as a title, stays.
    """
    spans = [tuple(containers[number][1:]) for number in articles]
    outer = {a for a in spans if not any(b != a and b[0] <= a[0] and a[1] <= b[1] for b in spans)}
    if len(outer) != 1:
        return
    (start, end), useful = outer.pop(), [0]
    for text, link, dropped in blocks:
        useful.append(useful[-1] + (0 if dropped else len(text) - link))
    if useful[end] - useful[start] < max(1, ARTICLE_SHARE * useful[-1]):
        return
    for number, (_, first, last) in enumerate(containers):
        if (last <= start or first >= end) and number not in around:
            for at in range(first, last):
                blocks[at][2] = True


def _drop_doubtful(doubtful: dict[int, float], containers: list, blocks: list) -> None:
    """Marks blocks of containers {number: share} that hold at most that share of the page."""
    sums = [0]
    for text, link, dropped in blocks:
        sums.append(sums[-1] + (0 if dropped else len(text) - link))
    drop: set[int] = set()
    done = 0
    for number, share in doubtful.items():
        _, start, end = containers[number]
        if sums[end] - sums[start] <= share * sums[-1]:
            drop.update(range(max(start, done), end))
            done = max(done, end)
    if any(not block[2] and at not in drop for at, block in enumerate(blocks)):
        for at in drop:
            blocks[at][2] = True


def container_scores(containers: list, blocks: list) -> list[tuple[float, float, int]]:
    """(score, score against dropped text too, useful characters) per container.

    Useful is text outside links and dropped parts. A score is useful text times
    the squared share it has of the text inside: of what is not dropped, as only
    that can get into the result, or of everything.
    """
    useful, kept, total = [0], [0], [0]
    for text, link, dropped in blocks:
        useful.append(useful[-1] + (0 if dropped else len(text) - link))
        kept.append(kept[-1] + (0 if dropped else len(text)))
        total.append(total[-1] + len(text))
    scores = []
    for _, start, end in containers:
        good = useful[end] - useful[start]
        shares = [good / (sums[end] - sums[start] or 1) for sums in (kept, total)]
        scores.append((good * shares[0] ** 2, good * shares[1] ** 2, good))
    return scores


def best_container(containers: list, blocks: list) -> int:
    """Number of the outermost container with the best score.

    Of a container that dropped text speaks less against, and that has nearly
    all of the useful text, the innermost one is taken. Without useful text, as
    in pages of links, it is the whole page.
    """
    scores = container_scores(containers, blocks)
    best = max(range(len(containers)), key=lambda i: (scores[i][0], -i))
    inner = max(range(len(containers)), key=lambda i: (scores[i][1], i))
    return inner if 0 < scores[best][2] * NEARLY_ALL <= scores[inner][2] else best


def page_votes(html: str) -> tuple[str | None, list[str]]:
    """Path of a page's best container, and paths of the outermost ones beside it.

    A path that also leads to, into or around the best container is not beside
    it. A page without text votes for nothing.
    """
    containers, blocks = parsed(html)
    best, start, end = containers[best_container(containers, blocks)]
    if all(dropped for _, _, dropped in blocks[start:end]):
        return None, []
    around, beside, at = set(), set(), 0
    for path, first, last in containers:
        if first < end and last > start:
            around.add(path)
        elif first >= at and first < last:
            at = last
            if not all(dropped for _, _, dropped in blocks[first:last]):
                beside.add(path)
    return best, sorted(beside - around)


def main_text(html: str, host_paths: list[str], left_out: list[str] | tuple = ()) -> str:
    """Text of the page's best container and of all containers with a path of the host.

    Containers with a path that the host leaves out are not part of it, unless
    they hold one of the host's paths or more than a small share of the page's
    useful text, or nothing else were left.
    """
    containers, blocks = parsed(html)
    kept = [at for at, block in enumerate(blocks) if not block[2]]
    _, start, end = containers[best_container(containers, blocks)]
    agreed = _inside(containers, host_paths)
    wanted = agreed.union(range(start, end))
    beside: set[int] = set()
    if left_out:
        useful = [0 if dropped else len(text) - link for text, link, dropped in blocks]
        most = LEFT_SHARE * sum(useful)
        for path, first, last in containers:
            if path in left_out and agreed.isdisjoint(range(first, last)) and sum(useful[first:last]) <= most:
                beside.update(range(first, last))
    if any(at in wanted and at not in beside for at in kept):
        wanted -= beside
    return "\n".join(blocks[at][0] for at in kept if at in wanted)


def _inside(containers: list, paths: list[str]) -> set[int]:
    """Numbers of the blocks in containers with one of the paths."""
    if not paths:
        return set()
    return {at for path, first, last in containers if path in paths for at in range(first, last)}


def host_paths(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, paths, left_out): what more than half of a host's pages agree on.

    Every page votes for the path of its best container and against those of
    the containers beside it. Counts are summed before the shuffle, so a host
    with a third of all pages sends a row per path. Each list is at most twice
    as long as the votes of an average page.
    """

    def vote(columns: dict[str, list]) -> dict[str, list]:
        made = {"host": [], "path": [], "best": []}
        for host, html in zip(columns["host"], columns["html"]):
            best, beside = page_votes(html or "")
            made["host"] += [host] * (1 + len(beside))
            made["path"] += [best, *beside]
            made["best"] += [True] + [False] * len(beside)
        return made

    votes = scratch.write(
        map_slices(pages.select("host", "html"), vote, "host string, path string, best boolean")
        .groupBy("host", "path", "best")
        .agg(F.count(F.lit(1)).alias("votes")),
        "votes",
    )
    sizes = votes.where("best").groupBy("host").agg(F.sum("votes").alias("n_pages"))
    return (
        votes.where("path is not null")
        .join(sizes, "host")
        .where("2 * votes > n_pages")
        .groupBy("host")
        .agg(
            F.collect_list(F.when(F.col("best"), F.col("path"))).alias("paths"),
            F.collect_list(F.when(~F.col("best"), F.col("path"))).alias("left_out"),
        )
    )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Blocks are joined by line feeds, white space inside a block is one space,
    character references are decoded. Pages without main text, null or empty
    ones have an empty text. Pages without a url are a host of their own. Rows
    that repeat a page are extracted each; no rows give no rows; other columns
    are not read.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.coalesce(
        F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1),
        F.lit(""),
    )
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    winners = scratch.write(host_paths(rows, scratch), "host_paths")

    def extract(columns: dict[str, list]) -> dict[str, list]:
        texts = [
            main_text(html or "", paths or [], left_out or [])
            for html, paths, left_out in zip(columns["html"], columns["paths"], columns["left_out"])
        ]
        return {
            "page_id": columns["page_id"],
            "url": columns["url"],
            "text": texts,
            "n_chars": [len(text) for text in texts],
        }

    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths", "left_out")
    return map_slices(joined, extract, "page_id long, url string, text string, n_chars long")
