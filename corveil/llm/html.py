"""HTML extraction: a suffix array of each host's token streams, then a check on the pages' markup.

The token streams of all pages of a host, marked content and what is outside of it alike, are concatenated, their
suffixes grouped by the first LONG tokens, and a suffix equal to one from another page starts a repeated substring.
Markup is evidence: what is outside of marked content on two pages, and not in it on more, is boilerplate. Tokens that
such substrings cover go; blocks keep their unique runs.

Where markup names the content, a check follows: the text of the article (or main) element without the menus, notices,
forms, adverts and comments in it stays whole, though the host repeats it, and what is outside goes, though it doesn't.
For pages that mark no such element, what the array leaves is the text.

The suffix array is distributed: its entries are rows (host, prefix of LONG tokens, page, position), and Spark groups
equal prefixes, which is all that the sorted order is asked for. Hence no host is ever in one task. A suffix's mark is
the least hash of the shorter runs in its prefix: equal prefixes have equal marks, and neighbours often share theirs. A
page's marks are sent packed, and a sieve holds back the suffixes whose mark only one page has.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corveil.llm.common import cut
from corveil.llm.langid import split_address
from corveil.llm.simhash import sieve

LONG = 8
#: A page's suffix of one key: in marked content, outside of it, or one more of that key.
AGAIN, OUTSIDE, INSIDE = 0, 1, 2
#: Bits of a mark, and of what is packed of it; marks packed at once, and pages whose suffixes go to a batch.
MARK, REST, MARKS, PAGES = 40, 30, 4_000_000, 256

# HTML's own element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe".split())
DROPPED = RAW | set("noscript template svg select option canvas audio video annotation annotation-xml head nav header footer aside form button menu dialog fieldset datalist".split())
#: Elements that don't end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object".split())
#: Those of formulas, too.
INLINE |= set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|gdpr|popup|modal|newsletter|subscri\w*|signup|paywall|nav|navbar|navigation|menu\w*|breadcrumb\w*|"
    r"sidebar\w*|widget\w*|related|recommend\w*|share|sharing|social\w*|comment\w*|disqus|footer|header|masthead|copyright|pagination|pager|toc|skip\w*)(?=$|[\s_-])",
    re.I,
)
#: Classes of articles that aren't the page's own.
OTHER_ARTICLE = re.compile(r"(?:^|\s)(?:[\w-]*comment[\w-]*|ads?|advert\w*|sponsor\w*|promo\w*|related[\w-]*|recommend[\w-]*)(?:$|\s)", re.I)
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements that a start tag closes if it finds them open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, past, whether it ends an element, lower-case name, attributes) of each tag; comments and declarations have no name.

    One pass forward: a `<` without any `>` behind it is text, a quote that never closes is an ordinary character. The
    contents of RAW elements are skipped with their start tag if they end at all.
    """
    at, n, unclosed, endless = 0, len(html), set(), set()
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            past = html.find("-->", start + 4)
            at = past + 3 if past >= 0 else n
            yield start, at, False, "", ""
            continue
        name = NAME.match(html, start + 1)
        if not name and not html.startswith(("<!", "<?"), start):
            at = start + 1
            continue
        if (past := html.find(">", start)) < 0:
            return
        if name:
            k = name.end()
            while (stop := STOP.search(html, k)) and stop[0] != ">":
                close = -1 if stop[0] in unclosed else html.find(stop[0], stop.end())
                if close < 0:
                    unclosed.add(stop[0])
                k = max(close + 1, stop.end())
            past = stop.start() if stop else past
        at = past + 1
        end, kind = bool(name and name[1]), name[2].lower() if name else ""
        if kind in RAW and not end and kind not in endless:
            closed = re.compile(rf"</{kind}\s*>", re.I).search(html, at)
            if closed or kind == "script":
                at = closed.end() if closed else n
                yield start, at, False, kind, "raw"
                continue
            endless.add(kind)
        yield start, at, end, kind, html[name.end() : past] if name else ""


def unwanted(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes.strip() or name in ("html", "body"):
        return False
    noise = OTHER_ARTICLE if name in ("article", "main") else NOISE
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and noise.search(value):
            return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(html: str) -> tuple[bool, list[str]]:
    """(whether markup names the content, its blocks in page order, white space collapsed, none empty)."""
    marked, found = all_blocks(html)
    return marked, [text for text, place in found if place == "content"]


def all_blocks(html: str) -> tuple[bool, list[tuple[str, str]]]:
    """(whether markup names the content, all blocks in page order with their place).

    The place is "content" (the articles, or without one the main element, or without both all that isn't unwanted),
    "rest" (what else isn't unwanted) or "unwanted".
    """
    found_in: list[tuple[str, tuple[str, ...]]] = []
    part: list[str] = []
    away: list[str] = []
    # Name, whether unwanted, and the place of the innermost element so far that isn't inline.
    open_: list[tuple[str, bool, int]] = []
    number: Counter[str] = Counter()
    state = {"article": 0, "main": 0, "out": 0}
    marked = set()

    def flush(part: list[str], wanted: bool = True) -> None:
        text = " ".join(unescape("".join(part)).split())
        part.clear()
        if text:
            found_in.append((text, (*[place for place in ("article", "main") if state[place]], "") if wanted else ()))

    def close(k: int) -> None:
        while len(open_) > k:
            name, bad, _ = open_.pop()
            number[name] -= 1
            if bad:
                state["out"] -= 1
            if name in ("article", "main"):
                state[name] -= 1

    at = 0
    for start, past, end, name, attributes in tags(html):
        if start > at:
            (away if state["out"] else part).append(html[at:start])
        at = past
        if not name:
            continue
        if name == "br":
            # A line break is white space inside its block.
            (away if state["out"] else part).append(" ")
            continue
        if name not in INLINE:
            flush(away, False)
            if not state["out"]:
                flush(part)
        if end:
            if number[name]:
                # All above it close with it.
                close(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name))
            continue
        block = open_[-1][2] if open_ else -1
        if block >= 0 and open_[block][0] in CLOSES.get(name, ()):
            close(block)
        if name in VOID or attributes.endswith("/") or name in RAW and attributes == "raw":
            continue
        # Without an end tag they last, like any unwanted element, to their parent's end.
        bad = unwanted(name, attributes)
        if name in ("article", "main"):
            state[name] += 1
            if not bad and not state["out"]:
                marked.add(name)
        state["out"] += bad
        number[name] += 1
        open_.append((name, bad, (open_[-1][2] if open_ else -1) if name in INLINE else len(open_)))
    (away if state["out"] else part).append(html[at:])
    flush(away, False)
    if not state["out"]:
        flush(part)
    content = next((p for p in ("article", "main") if p in marked), "")
    return bool(marked), [(text, "content" if content in places else "rest" if places else "unwanted") for text, places in found_in]


def tokens(found: Iterable[str]) -> list[str]:
    return [t for b in found for t in b.split(" ")]


def page_streams(html: str) -> tuple[bool, bytes, int]:
    """(whether markup names the content, the page's two streams packed, digest) of a page.

    The streams are the content's blocks and the rest: on marked pages the blocks outside of the content, on open ones
    all blocks if some are unwanted, as another page may have the same text without such markup. Line ends part blocks,
    an empty line the streams; no block holds either. Pages whose digest is equal count as one page: those with the same
    open content, or the same in all blocks.
    """
    marked, found = all_blocks(html)
    content = [text for text, place in found if place == "content"]
    digest = xxhash.xxh64_intdigest("\n".join([place + text for text, place in found] if marked else content)) - (1 << 63)
    rest = [text for text, place in found if place != "content" or not marked] if len(content) < len(found) else []
    return marked, zlib.compress("\n\n".join(("\n".join(content), "\n".join(rest))).encode(), 1), digest


def streams(packed: bytes) -> tuple[str, str]:
    content, _, rest = zlib.decompress(packed).decode().partition("\n\n")
    return content, rest


def page_suffixes(packed: bytes, marked: bool, host: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, mark, place in the content, kind) of all suffixes of a page, from its content and from the rest.

    The key is a hash of the host and the first `long` tokens, the mark one of some of those. Suffixes of
    the rest have no place (-1) and stand there once. The kind counts pages: for one suffix a key it is INSIDE or
    OUTSIDE of marked content, for the others AGAIN.
    """
    content, rest = (tokens(x.split("\n")) if x else [] for x in streams(packed))
    keys, found = (list(x) for x in zip(*(suffixes(x, long, host) for x in (content, rest)), strict=True))
    first = [np.unique(k, return_index=True)[1] for k in keys]
    kind = np.full(len(keys[0]), AGAIN, np.int8)
    kind[first[0]] = INSIDE if marked else OUTSIDE
    alone = first[1] if marked else first[1][~np.isin(keys[1][first[1]], keys[0])]
    place = np.concatenate([np.arange(len(keys[0]), dtype=np.int32), np.full(len(alone), -1, np.int32)])
    return np.concatenate([keys[0], keys[1][alone]]), np.concatenate([found[0], found[1][alone]]), place, np.concatenate([kind, np.full(len(alone), OUTSIDE, np.int8)])


def suffixes(tokens: list[str], long: int, host: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, mark) of each suffix's first `long` tokens; suffixes that are shorter have none."""
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    short = max(1, long * 5 // 8)
    some = rolled(each, short, host) >> np.uint64(64 - MARK)
    found = np.zeros(0, np.uint64) if len(each) < long else np.minimum.reduce([some[k : len(each) - long + 1 + k] for k in range(long - short + 1)])
    return rolled(each, long, host).view(np.int64), found.view(np.int64)


def rolled(each: np.ndarray, long: int, host: int) -> np.ndarray:
    """A hash of each run of `long` hashes, and of the host."""
    out = np.full(max(0, len(each) - long + 1), host, np.uint64)
    for k in range(long if len(out) else 0):
        out = (out ^ each[k : len(each) - long + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    # The upper bits, of which marks are made, depend on all of the last token.
    return (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def pack_marks(held: list[np.ndarray]) -> pa.RecordBatch:
    """(part, packed) of marks: sorted, a mark at most twice, as differences by bytes, for each value of the upper bits."""
    found, times = np.unique(np.concatenate(held), return_counts=True)
    found = np.repeat(found, np.minimum(times, 2))
    edges = np.searchsorted(found, np.arange((1 << MARK - REST) + 1, dtype=np.int64) << REST)
    parts = np.flatnonzero(edges[1:] > edges[:-1])
    steps = [np.diff(found[edges[k] : edges[k + 1]] & ((1 << REST) - 1), prepend=0).astype("<u4") for k in parts]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in steps], pa.binary())], ["part", "packed"])


def twice(key: tuple, found: pa.Table) -> pa.Table:
    """The marks of one part that two pages have."""
    each = [np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().cumsum(dtype=np.int64) for x in found.column("packed").to_pylist()]
    marks, times = np.unique(np.concatenate(each), return_counts=True)
    return pa.table({"mark": marks[times > 1] + (key[0].as_py() << REST)})


def unique_runs(text: str, covered: np.ndarray) -> str:
    """What is left of a block without its covered tokens, down to single ones."""
    return " ".join(t for t, c in zip(text.split(" "), covered.tolist(), strict=True) if not c)


def extract(pages: DataFrame, long: int = LONG, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, marked, covered) of every page; `marked`: markup names its content.

    `covered` is the number of the content's tokens that the host's array finds on another page too, wherever they stand
    there. By markup they stay where it names the content; from open pages they go if they are boilerplate. Null or empty html gives an empty text. Pages without host (null
    address, or without ://) are of one host. Equal pages of a host count as one: what they share is boilerplate only
    if another page has it too. Pages with the same id are pages of their own. Whole pages, of any length.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_streams(x.as_py() or "") for x in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.bool_(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page", "marked", "text", "digest"])

    def of_pages(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for host, marked, packed in zip(*(batch.column(c).to_pylist() for c in ("host", "marked", "text")), strict=True):
            yield page_suffixes(packed, marked, xxhash.xxh64_intdigest(host), long)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, found, _, _ in of_pages(batch):
                held.append(np.unique(found))
                size += len(held[-1])
                if size > MARKS:
                    yield pack_marks(held)
                    held, size = [], 0
        if size:
            yield pack_marks(held)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PAGES):
                some = batch.slice(at, PAGES)
                found = list(of_pages(some))
                sizes = [len(x[0]) for x in found]
                of_page = [np.repeat(some.column(c).to_numpy(), sizes) for c in ("row", "digest")]
                columns = [*of_page, *(np.concatenate(x) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "digest", "key", "mark", "position", "kind"])

    def cover(starts: list[int], size: int) -> np.ndarray:
        covered = np.zeros(size + 1, np.int64)
        np.add.at(covered, np.array(starts, np.int64), 1)
        np.add.at(covered, np.array(starts, np.int64) + long, -1)
        return np.cumsum(covered)[:-1] > 0

    def uncover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total = [], []
            for marked, packed, starts, goes in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                text, _ = streams(packed)
                found = text.split("\n") if text else []
                sizes = [b.count(" ") + 1 for b in found]
                total.append(int(cover(starts, sum(sizes)).sum()) if starts else 0)
                # The check on markup: what it names stays, though the host repeats it.
                if goes and not marked:
                    flags = np.split(cover(goes, sum(sizes)), np.cumsum(sizes))[:-1]
                    text = "\n".join(x for b, f in zip(found, flags, strict=True) if (x := unique_runs(b, f)))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(total, pa.int64())], ["page", "marked", "text", "covered"])

    host = F.coalesce(split_address(F.col(url_col).cast("string"))[0], F.lit(""))
    page = F.struct(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"))
    kind = "page struct<page_id: long, url: string, host: string>, marked boolean"
    d = pages.select(page.alias("page"), F.col(html_col).cast("string").alias("html")).mapInArrow(read, f"{kind}, text binary, digest long")
    # Checkpointed, so that the numbers given to rows below are the same whenever they are computed.
    d = cut(d).withColumn("row", F.monotonically_increasing_id())
    # All suffixes of all pages. Those whose mark no other page has are in no second page, and are held back.
    known = d.select("row", "page.host", "marked", "text", "digest")
    common = cut(known.mapInArrow(marks, "part int, packed binary").groupBy("part").applyInArrow(twice, "mark long"))
    entries = known.mapInArrow(spread, "row long, digest long, key long, mark long, position int, kind byte")
    entries = sieve(entries, "mark", common)[0].drop("mark")
    # The array's repeats are on two pages, wherever they stand there; by markup they are boilerplate if two pages have them outside of marked content, and not more in it.
    alike = W.partitionBy("key")
    over = lambda f, x: f(x).over(alike)
    pages_of = lambda kind: F.sum((F.col("kind") == kind).cast("long")).over(alike)
    outside = F.when(F.col("kind") == OUTSIDE, F.col("digest"))
    shared = F.coalesce((over(F.min, outside) != over(F.max, outside)) & (pages_of(OUTSIDE) >= pages_of(INSIDE)), F.lit(False))
    entries = entries.withColumns({"repeats": over(F.min, F.col("digest")) != over(F.max, F.col("digest")), "shared": shared}).filter("repeats and position >= 0")
    # Only pages with repeated substrings have rows here; a page's positions are as many as its tokens.
    repeated = cut(entries.groupBy("row").agg(F.collect_set("position").alias("starts"), F.collect_set(F.when(F.col("shared"), F.col("position"))).alias("goes")))
    some, none = sieve(d.select("row", "page", "marked", "text"), "row", repeated)
    empty = F.array().cast("array<int>")
    some = some.join(repeated, "row", "left").select("page", "marked", "text", F.coalesce("starts", empty).alias("starts"), F.coalesce("goes", empty).alias("goes"))
    out = some.unionByName(none.select("page", "marked", "text", empty.alias("starts"), empty.alias("goes"))).mapInArrow(uncover, f"{kind}, text string, covered long")
    return out.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"), "marked", "covered")
