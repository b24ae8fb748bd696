"""Main text of web pages by consensus paths per host.

1. Each page is parsed once. Text blocks outside boilerplate (menus, headers, footers, sidebars, notices, adverts, forms,
   scripts, styles, comments of readers) count for the containers around them. A container's score is its own text weight,
   discounted by the share of boilerplate inside it, with a bonus for article-like tags and classes. By its names an element is
   boilerplate only if a whole class, id or role consists of such words (``ad``, ``cookie-notice``), none is article-like, it is no
   text block such as a paragraph, and it does not hold most of a page's text with hardly any in article-like elements. Else such words (``no-sidebar``, ``related-work``)
   only halve what its text counts for, unless a name is article-like (``content no-sidebar``).
2. Votes: every page splits a thousand votes over the generalised paths (tags and classes, digits folded) of its containers in
   proportion to their scores. Spark sums the votes per (host, path), pre-aggregated before the shuffle, and each host's
   path with the most votes wins (ties: the shorter, then the smaller path).
3. Each page is parsed again and the text is taken from the elements on its host's winning path; a page without such an
   element, or with no text there, uses its own best container.

The table of winning paths has one short row a host. Up to ``FEW_HOSTS`` hosts, which is counted, it is broadcast and pages are
not shuffled. Beyond, pages are dealt by (host, salt) and the paths once per salt, so that a host with many pages is split.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order
by one space. Blocks are headings, paragraphs, list items, cells and the like; inline tags add no space; ``br`` counts as white
space. Null or empty html gives an empty text; a null URL or one without ``://`` is host ``''`` like any other. Unclosed or stray
tags are tolerated, and an unfinished tag at the end is text of its own that is dropped as markup. Whole pages are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, free_name, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
DIGITS = re.compile(r"\d+")

# fixed values of HTML: elements without content, with raw content, and that end an open paragraph
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td".split())
#: An open element of the first kind ends where one of its second kind begins (inside the same parent).
ENDS = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "option": frozenset(("option",)),
}
SCOPE = frozenset("ul ol dl table tbody thead tfoot select".split())
#: Elements whose text is not the article's.
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe button select dialog menu svg head textarea title object canvas math".split())
#: Words in class, id or role that mark boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager "
    "popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription teaser toolbar widget complementary contentinfo navigation dialog alert gdpr paywall".split()
)
ARTICLE_WORDS = frozenset("article content post entry story main text body".split())
#: Elements that no name makes boilerplate, and those that names do not even discount.
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCK = HEADING | frozenset("p pre blockquote dt dd".split())
UNNAMED = frozenset("html body article main".split())
#: Share of the page's text beyond which an element is no boilerplate by its names, and what text under such names counts.
#: The first needs that article-like elements hold less than ``TOLD`` outside such names and headings (an article may have many comments).
DOMINANT, TOLD, DISCOUNT = 0.75, 0.05, 0.5
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "path", "skip", "container", "own", "all", "parent", "name_bonus", "hard", "low", "gap", "named", "article")

    def __init__(self, tag, path, skip, container, parent):
        self.tag, self.path, self.skip, self.container, self.parent = tag, path, skip, container, parent
        self.own = self.all = 0  # characters of article-like text (discounted), and of any text, within
        self.name_bonus = 1.0
        self.hard = self.low = self.article = False  # boilerplate by tag or hidden; within names that are a discount; within an article
        self.gap = 1.0  # what a character here counts for the next container above
        self.named = None  # (number, the same of the next one above) of elements that are boilerplate by their names


def _names(attributes: str) -> tuple[str, list[frozenset], bool]:
    """(class for the path, words of each class, id and role, hidden)."""
    if not attributes or attributes.isspace():
        return "", [], False
    classes, found, hidden = "", [], False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name in ("class", "id", "role"):
            found += [frozenset(w for w in SPLIT.split(token) if w and not w.isdigit()) for token in entities.unescape(value).lower().split()]
            if name == "class":
                classes = ".".join(sorted(set(value.lower().split())))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return classes, found, hidden


def _named(names: list[frozenset]) -> tuple[bool, bool, bool]:
    """(a name consists of boilerplate words, a name holds one, a name is article-like) of an element's names."""
    whole = any(words and words <= BOILERPLATE_WORDS for words in names)
    part = any(not words.isdisjoint(BOILERPLATE_WORDS) for words in names)
    return whole, part, any(not words.isdisjoint(ARTICLE_WORDS) and words.isdisjoint(BOILERPLATE_WORDS) for words in names)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The containers of a page, and its text blocks as (innermost container, text) in page order, boilerplate left out."""
    containers, blocks, inside, told, total = _parse(page, frozenset())
    # again, if elements that are boilerplate by their names hold most of the text
    spared = frozenset(number for number, size in inside.items() if size > DOMINANT * total) if told < TOLD * total else None
    return _parse(page, spared)[:2] if spared else (containers, blocks)


def _parse(page: str, spared: frozenset) -> tuple[list[Node], list[tuple[Node, str]], dict[int, int], int, int]:
    """Also the characters in each element that is boilerplate by its names, in article-like elements outside these, and in all that
    are no boilerplate by tag or hidden.

    ``spared`` are numbers of such elements that are none.
    """
    root = Node("", "", False, True, None)
    containers, blocks, stack, pieces = [root], [], [root], []
    inside: dict[int, int] = {}
    total = told = number = 0

    def flush():
        nonlocal total, told
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                top = stack[-1]
                inner = next(n for n in reversed(stack) if n.container)
                size, skip = len(text), top.skip
                if not skip:
                    blocks.append((inner, text))
                if not top.hard:
                    total += size
                    named = top.named
                    told += size if named is None and top.article else 0
                    while named is not None:
                        inside[named[0]] = inside.get(named[0], 0) + size
                        named = named[1]
                node, counts = inner, size if top.container else size * top.gap
                while node is not None:
                    node.all += size
                    if not skip:
                        node.own += counts
                    counts *= node.gap
                    node = node.parent

    def close(depth):
        flush()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        match = TOKEN.search(page, at)
        if match is None:
            pieces.append(page[at:])
            break
        if match.start() > at:
            pieces.append(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    if tag in BLOCK or stack[depth].skip:
                        close(depth)
                    else:
                        # an inline end tag closes inline elements only
                        if not any(n.tag in BLOCK for n in stack[depth + 1 :]):
                            del stack[depth:]
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            for depth in range(len(stack) - 1, 0, -1):  # an open paragraph or heading ends here
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCK:
                    break
            for depth in range(len(stack) - 1, 0, -1):
                if tag in ENDS.get(stack[depth].tag, ()):
                    close(depth)
                    if tag not in ("td", "th", "tr") or tag == "tr":
                        break
                elif stack[depth].tag in SCOPE:
                    break
        if tag in VOID:
            continue
        classes, names, hidden = _names(match[3])
        parent = next(n for n in reversed(stack) if n.container)
        top = stack[-1]
        inside_article = any(n.tag in ("article", "main") for n in stack)
        hard = top.hard or hidden or (tag in BOILERPLATE and not (tag == "header" and inside_article))
        whole, part, article_like = _named(names) if names else (False, False, False)
        named, low = top.named, part and not article_like and tag not in UNNAMED
        skip = top.skip or hard
        if low and whole and tag not in TEXT_BLOCK:
            number += 1
            named = (number, named)
            low = number not in spared
            skip = skip or low
        if tag in RAW:
            flush()
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", stop.end()) + 1 or end if stop else end
            continue
        label = DIGITS.sub("#", f"{tag}.{classes}" if classes else tag)
        node = Node(tag, f"{parent.path}/{label}" if tag in CONTAINER else parent.path, skip, tag in CONTAINER, parent)
        node.hard, node.named, node.low = hard, named, top.low or low
        node.article = (top.article or article_like or tag in ("article", "main")) and tag not in HEADING
        node.gap = (DISCOUNT if low else 1.0) * (1.0 if top.container else top.gap)
        if skip and not top.skip or tag in BLOCK:
            flush()
        if tag in ("article", "main"):
            node.name_bonus = 1.5
        elif article_like:
            node.name_bonus = 1.25
        if node.low:
            node.name_bonus *= DISCOUNT
        if node.container and not skip:
            containers.append(node)
        stack.append(node)
    flush()
    return containers, blocks, inside, told, total


def scores(containers: list[Node]) -> dict[str, float]:
    """Score by path; elements on one path add up."""
    found: dict[str, list[float]] = {}
    for node in containers:
        if node.own:
            sums = found.setdefault(node.path, [0, 0, 0.0])
            sums[0] += node.own
            sums[1] += node.all
            sums[2] = max(sums[2], node.name_bonus)
    return {path: own * (own / total) ** 2 * bonus for path, (own, total, bonus) in found.items()}


def best(found: dict[str, float]) -> str | None:
    """The path with the highest score; the deeper one wins a tie."""
    return max(found, key=lambda p: (found[p], len(p), p)) if found else None


def text_on(path: str, blocks: list[tuple[Node, str]]) -> str:
    inside = path + "/"
    return " ".join(text for node, text in blocks if node.path == path or node.path.startswith(inside))


def main_text(page: str | None, path: str | None) -> str:
    """Text on ``path``, else on the page's own best path."""
    containers, blocks = parse(page or "")
    text = text_on(path, blocks) if path is not None else ""
    if not text:
        own = best(scores(containers))
        text = text_on(own, blocks) if own is not None else ""
    return text


FEW_HOSTS = 100_000
SALTS = 32


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], int] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = scores(parse(page.as_py() or "")[0])
            total = sum(found.values())
            for path, score in found.items():
                sums[host, path] = sums.get((host, path), 0) + round(1000 * score / total)
        rows = [(h, p, v) for (h, p), v in sums.items() if v]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "path", "votes"])


def host_paths(pages: DataFrame, host: str, html: str) -> DataFrame:
    """``host, path``: the winning path of each host."""
    votes = pages.select(F.col(host), F.col(html)).mapInArrow(_vote, "host string, path string, votes bigint")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # the smallest struct per host: most votes, then the shorter, then the smaller path; combined before the shuffle
    rank = F.struct(-F.col("votes"), F.length("path"), F.col("path").alias("path"))
    return summed.groupBy("host").agg(F.min(rank)["path"].alias("path"))


def extract(pages: DataFrame, scratch: Scratch, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (an underscore is added where a name is taken)."""
    kept = [c for c in pages.columns if c != html]
    host, path, text, n_chars = (free_name(c, pages.columns) for c in ("host", "path", "text", "n_chars"))
    hosted = pages.withColumn(host, F.lower(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))))
    winners = scratch.keep(host_paths(hosted, host, html).withColumnsRenamed({"host": host, "path": path}), "paths")
    if winners.count() <= FEW_HOSTS:
        joined = hosted.join(F.broadcast(winners), host, "left")
    else:
        salt = free_name("salt", hosted.columns + [path])
        salted = hosted.withColumn(salt, F.pmod(F.xxhash64(url, html), F.lit(SALTS)).cast("int"))
        joined = salted.join(winners.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [host, salt], "left")
    schema = pages.select(*[F.col(f"`{c}`") for c in kept]).schema.add(text, "string")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(len(kept)).to_pylist()
            texts = [main_text(page.as_py(), p) for page, p in zip(batch.column(len(kept) + 1), paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, text])

    taken = joined.select(*[F.col(f"`{c}`") for c in kept], path, html).mapInArrow(take, schema)
    return taken.withColumn(n_chars, F.char_length(F.col(text)).cast("long"))


def op10_html_extract(spark, folder):
    return extract(table(spark, folder, "pages").select("page_id", "url", "html"), Scratch(spark)).select("page_id", "url", "text", "n_chars")
