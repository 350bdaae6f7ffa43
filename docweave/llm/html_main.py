"""Main text of HTML pages: structure marks what surely is or is not the article, a suffix array over each
host's token streams finds what its pages repeat.

Every page becomes blocks in page order, each with a role: `main` (inside an article or main element), `body` (unmarked)
or `off` (menus, headers, footers, sidebars, notices, adverts, forms, reader comments by element, role, class or
id). The blocks' words of all pages of a host make one stream; its suffixes are sorted by prefix doubling
up to `run` words, so that suffixes of equal rank share a run of that length. Runs that occur on enough distinct pages of
the host cover their words: every substring of `run` words or more that is repeated so is covered whole. A page's text is its
main blocks, or its body blocks if it has none. Of body blocks the covered runs are cut out and the rest stays; a main block
goes only if it is covered whole by runs within it (a notice among the article's paragraphs), for a passage in a paragraph with
words of its own is the article's, and so is a headline that several articles share. A page whose main blocks are covered by half or
more, or whose body blocks all are, is a copy, not a frame, and stays whole.

A host's pages are dealt into chunks of about `chunk_bytes`, so a host with a third of all pages is many tasks. A run on
enough pages of the host has its share of them in some chunk at least: those are the candidates, which are then
counted in all chunks, so that the result does not depend on the chunks.
"""

from __future__ import annotations

import math
import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import bounded_batches, stored, utf8
from docweave.llm.words import SPACED, mix, word_hashes

#: Fixed values, by HTML's own rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|math|object|canvas|textarea|select|title|audio|video"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OFF = frozenset("nav footer aside form menu dialog button head".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A start of the first closes an open one of the second.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A start of these closes an open p, up to an element in which paragraphs are apart.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
P_SCOPE = frozenset("button caption html table td th".split())
#: Class names and ids of what is not the article: tokens whose parts are all among them or PLACES, one of them at least.
OFF_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets rail footer foot header masthead topbar notice notices cookie cookies consent gdpr alert popup modal overlay comment comments commentlist disqus discussion replies reply respond share sharing social related recommended recirc newsletter subscribe subscription pagination pager toc skip".split()
)
PLACES = frozenset("site global top bottom left right box bar list link links button buttons".split())
#: What never holds the page's own article.
APART = frozenset("nav footer aside menu dialog".split())

#: Partitions of chunks grow in number with the pages, to MOST_PARTITIONS; what a task holds at once is a chunk.
PARTITION_BYTES, MOST_PARTITIONS = 8_000_000, 100_000

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ENDS = re.compile(r"[>\"']")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW.split("|")}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z]+")


class Tag(NamedTuple):
    """name is empty for what is passed over: comments, declarations, and elements of raw text with all that is in them."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""
    raw: bool = False


def tags_of(page: str) -> list[Tag]:
    """The tags of a page in one pass. A comment or a raw element without an end goes to the end of the page. If a tag's quotes never
    close, it ends at its first >, and quotes count for nothing from there on; one without any > is the end of the page."""
    out, at, size, quotes = [], 0, len(page), True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = size if end < 0 else end + 3
            out.append(Tag(start, at))
            continue
        if page[at : at + 1] in ("!", "?"):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            out.append(Tag(start, at))
            continue
        m = _NAME.match(page, at)
        if not m:
            continue
        end = _tag_end(page, m.end()) if quotes else page.find(">", m.end())
        if end < 0 and quotes:
            quotes, end = False, page.find(">", m.end())
        at = size if end < 0 else end + 1
        name, closing, attributes = m[1].lower(), page[start + 1] == "/", page[m.end() : max(end, m.end())]
        if name in _RAW_ENDS and not closing:
            if not attributes.endswith("/"):
                over = _RAW_ENDS[name].search(page, at)
                at = over.end() if over else size
            out.append(Tag(start, at, raw=True))
        else:
            out.append(Tag(start, at, name if end >= 0 else "", closing, attributes))
    return out


def _tag_end(page: str, at: int) -> int:
    """Where the > of a tag is, quoted ones passed over; -1 if there is none."""
    first = page.find(">", at)
    if first < 0 or "'" not in (plain := page[at:first]) and plain.count('"') % 2 == 0:
        return first
    while m := _ENDS.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def _off(tag: str, attributes: str) -> bool:
    if tag in OFF:
        return True
    if not attributes:
        return False
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x), "").lower()
        if name in seen:
            continue
        seen.add(name)
        if name == "role":
            if value in OFF_ROLES:
                return True
        elif name in ("class", "id"):
            if tag not in ("html", "body", "main") and any(_off_name(token) for token in value.split()):
                return True
        elif name == "hidden" and tag not in ("html", "body"):
            return True
        elif name == "aria-hidden" and value == "true":
            return True
    return False


def _off_name(token: str) -> bool:
    parts = _PARTS.findall(token)
    return not OFF_NAMES.isdisjoint(parts) and all(p in OFF_NAMES or p in PLACES for p in parts)


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(text, role) of each block with text, in page order."""
    if not page:
        return []
    tags = tags_of(page)
    for own in ("main", "article"):
        if any(t.name == own and not t.closing for t in tags):
            found = _walked(page, tags, own, frozenset())
            return _walked(page, tags, own, found) if isinstance(found, frozenset) else found
    found = _walked(page, tags, "", frozenset())
    forms = frozenset(t.start for t in tags if t.name == "form")
    if forms and all(role == "off" for _, role in found):  # a form around the whole page
        found = _walked(page, tags, "", forms)
    return found


def _walked(page: str, tags: list[Tag], own: str, spared: frozenset[int]) -> list[tuple[str, str]] | frozenset[int]:
    """The blocks, elements that start at `spared` not switched off; or, if the page's own article (the first `own` element that
    is not set apart) lies in an element switched off or is one, the starts of those that hold it and its own."""
    out, piece = [], []
    stack: list[tuple[str, int, int, int]] = []  # tag, off and main as they were outside, start
    off = main = 0
    at = 0

    def close():
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            piece.clear()
            if text:
                out.append((text, "off" if off else "main" if main else "body"))

    def leave(k: int):
        nonlocal off, main
        _, off, main, _ = stack[k]
        del stack[k:]

    def closes(open_ones, scope):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in open_ones:
                return leave(k)
            if stack[k][0] in scope:
                return

    for t in tags:
        if t.start > at:
            piece.append(page[at : t.start])
        at, tag = t.end, t.name
        if not tag:
            if t.raw:
                piece.append(" ")
            continue
        if tag in BLOCK:
            close()
        elif tag == "br":
            piece.append(" ")
        if tag in VOID:
            if tag == "hr":
                closes(("p",), P_SCOPE)
            continue
        if t.closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
            continue
        if t.attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in IMPLIED:
            closes(IMPLIED[tag], ("ul", "ol", "dl", "table", "div", "article", "section"))
        elif tag in CLOSES_P:
            closes(("p",), P_SCOPE)
        stack.append((tag, off, main, t.start))
        if t.start not in spared and (_off(tag, t.attributes) or tag == "header" and not main):
            off += 1
        elif tag in ("article", "main"):
            main += 1
        if tag == own and not spared and APART.isdisjoint(x[0] for x in stack):
            if off:
                return frozenset(x[3] for x in stack)
            own = ""
    if at < len(page):
        piece.append(page[at:])
    close()
    return out


def _suffixes(hashes: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the stream's whole runs of `run` words (a power of two), in page order within a rank; their ranks;
    and by rank the number of distinct pages. page: the page of each word, ascending. Runs do not cross pages."""
    n = len(hashes)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    rank = np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    while length < run:
        later = np.zeros(n, np.int64)
        later[:-length] = np.where(page[length:] == page[:-length], rank[length:], 0)
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64) + 1
        length *= 2
    suffixes = np.flatnonzero(_whole(page, run))
    suffixes = suffixes[np.argsort(rank[suffixes], kind="stable")]
    r, p = rank[suffixes], page[suffixes]
    new = np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])) if len(r) else np.zeros(0, bool)
    return suffixes, r, np.bincount(r[new], minlength=int(rank.max()) + 1)


def _whole(part: np.ndarray, run: int) -> np.ndarray:
    """Where a run of `run` words begins that does not leave its part (a page, a block; ascending)."""
    whole = np.zeros(len(part), bool)
    if len(part) >= run:
        whole[: len(part) - run + 1] = part[run - 1 :] == part[: len(part) - run + 1]
    return whole


def _covered(first: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n words lie in a run that begins at one of `first`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + run, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(hashes: np.ndarray, page: np.ndarray, run: int, least: int) -> np.ndarray:
    """Which words of the stream lie in a run of `run` words (a power of two) that occurs on `least` distinct pages.
    page: the page of each word, ascending. Runs do not cross pages."""
    suffixes, rank, pages = _suffixes(hashes, page, run)
    return _covered(suffixes[pages[rank] >= least], len(hashes), run)


def run_keys(hashes: np.ndarray, run: int) -> np.ndarray:
    """A hash of the `run` words (a power of two) from each place on, the same in every stream; 0 beyond the last whole run."""
    key, length = hashes.copy(), 1
    while length < run:
        later = np.zeros(len(key), np.uint64)
        later[:-length] = key[length:]
        key = mix(key * np.uint64(0x9E3779B97F4A7C55) + later)
        length *= 2
    key[max(len(key) - run + 1, 0) :] = 0
    return key


def frame_pages(pages: int, least_pages: int) -> int:
    """On how many of a host's pages a run is a frame: their number's square root, least_pages at least."""
    return max(least_pages, math.isqrt(max(pages - 1, 0)) + 1)


def extract(pages: DataFrame, keep: tuple[str, ...], html: str = "html", host=None, run: int = 16, least_pages: int = 3, copied_share: float = 0.5, chunk_bytes: int = 4_000_000) -> DataFrame:
    """The keep columns and text (blocks joined by two line feeds; empty if there is none) of every row of pages.

    host: a column (null is a host of its own). A run counts as repeated on frame_pages(the host's, least_pages) distinct
    pages of the whole host. Null html is an empty page. Repeated rows stay, other columns are not looked at.
    """

    def parse(column: pa.Array) -> pa.Array:
        found = [blocks(x) for x in column.to_pylist()]
        flat = [b for own in found for b in own]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.string()), pa.array([r for _, r in flat], pa.string())], ["text", "role"]))

    bounded_batches(pages.sparkSession)
    own_host = F.coalesce(host if host is not None else F.lit(""), F.lit("")).alias("host")
    names = [f"k{k}" for k in range(len(keep))]
    sizes = stored(pages.select(own_host, F.length(html).alias("bytes")).groupBy("host").agg(F.sum("bytes").alias("all"), F.count("*").alias("pages")), "sizes")
    large = sizes.where(F.col("all") > chunk_bytes).select("host", F.ceil(F.col("all") / chunk_bytes).alias("chunks"), "pages")
    sized = pages.select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], own_host, F.xxhash64(html, *keep).alias("salt"), F.col(html).alias("html")).join(F.broadcast(large), "host", "left")
    whole = sizes.agg(F.sum("all")).first()[0] or 0
    parts = min(max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole // PARTITION_BYTES), MOST_PARTITIONS)

    def dealt(rows: DataFrame) -> DataFrame:
        read = rows.select("host", F.coalesce(F.pmod("salt", "chunks"), F.lit(0)).alias("chunk"), "chunks", "pages", *names, F.arrow_udf(parse, "array<struct<text:string,role:string>>")("html").alias("blocks"))
        return read.repartition(parts, "host", "chunk")

    def stream(table: pa.Table):
        """The blocks and their number on each page; word hashes, word offsets of the blocks, and the page of each word."""
        own = table["blocks"].combine_chunks()
        flat, n_blocks = own.flatten(), np.diff(np.asarray(own.offsets))
        h, at = word_hashes(*utf8(flat.field("text")), SPACED)
        return flat, n_blocks, h, at, np.repeat(np.repeat(np.arange(len(table)), n_blocks), np.diff(at))

    def chosen(table: pa.Table, flat: pa.Array, n_blocks: np.ndarray, at: np.ndarray, first: np.ndarray) -> pa.Table:
        """first: where runs begin that are frames. A block goes if they cover it all, of a main block runs within it; of
        other body blocks the words of runs within go."""
        n_words = np.diff(at)
        inside = _whole(np.repeat(np.arange(len(n_words)), n_words), run)
        seen, cut = _covered(first, int(at[-1]), run), _covered(first[inside[first]], int(at[-1]), run)
        texts, roles = flat.field("text").to_pylist(), flat.field("role").to_pylist()
        seen = np.where(np.repeat(np.array([r == "main" for r in roles], bool), n_words), cut, seen)
        sums = np.concatenate([[0], np.cumsum(seen)])
        covered = sums[at[1:]] - sums[at[:-1]]

        def rest(b: int) -> str:
            if covered[b] == n_words[b]:
                return ""
            if roles[b] == "main":
                return texts[b]
            gone = cut[at[b] : at[b + 1]]
            return " ".join(w for w, c in zip(texts[b].split(" "), gone.tolist(), strict=True) if not c) if gone.any() else texts[b]

        out, low = [], 0
        for n in n_blocks:
            mine = range(low, low + n)
            low += n
            held = [b for b in mine if roles[b] == "main"]
            copied = bool(held) and covered[held].sum() >= copied_share * n_words[held].sum()
            held = held or [b for b in mine if roles[b] == "body"]
            left = [] if copied else [t for t in map(rest, held) if t]
            out.append("\n\n".join(left or [texts[b] for b in held]))
        return table.select(names).append_column("text", pa.array(out, pa.string()))

    def alone(table: pa.Table) -> pa.Table:
        flat, n_blocks, h, at, page = stream(table)
        suffixes, rank, n_pages = _suffixes(h, page, run)
        return chosen(table, flat, n_blocks, at, suffixes[n_pages[rank] >= frame_pages(len(table), least_pages)])

    def tallied(table: pa.Table, key: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"host": pa.array([table["host"][0].as_py()] * len(key), pa.string()), "key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    def candidates(table: pa.Table) -> pa.Table:
        """Runs on so many of the chunk's pages that the host's may be enough: a frame has its part in some chunk."""
        _, _, h, _, page = stream(table)
        suffixes, rank, n_pages = _suffixes(h, page, run)
        once = np.append(True, rank[1:] != rank[:-1]) if len(rank) else np.zeros(0, bool)
        need = -(-frame_pages(table["pages"][0].as_py(), least_pages) // table["chunks"][0].as_py())
        once &= n_pages[rank] >= need
        return tallied(table, run_keys(h, run)[suffixes[once]], n_pages[rank[once]])

    def found(table: pa.Table, asked: pa.Table):
        """(first, key, page of each word): the places of the asked runs."""
        flat, n_blocks, h, at, page = stream(table)
        key = run_keys(h, run)
        wanted = np.unique(asked["key"].to_numpy().view(np.uint64))
        there = _whole(page, run)
        if len(wanted):
            there &= wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
        return flat, n_blocks, at, np.flatnonzero(there) if len(wanted) else np.zeros(0, np.int64), key, page

    def counts(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(table) or not len(asked):
            return pa.table({"host": pa.array([], pa.string()), "key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        *_, first, key, page = found(table, asked)
        order = np.lexsort((page[first], key[first]))
        k, p = key[first][order], page[first][order]
        new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])) if len(k) else np.zeros(0, bool)
        return tallied(table, *np.unique(k[new], return_counts=True))

    def choose(table: pa.Table, frames: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({n: pa.array([], table.schema.field(n).type) for n in names} | {"text": pa.array([], pa.string())})
        flat, n_blocks, at, first, _, _ = found(table, frames)
        return chosen(table, flat, n_blocks, at, first)

    result = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)) + ", text string"
    done = dealt(sized.where("chunks is null")).groupBy("host", "chunk").applyInArrow(alone, result)
    if not large.isEmpty():
        # one exchange, read three times: candidates by suffix array, their host-wide counts, the texts
        chunked = dealt(sized.where("chunks is not null"))
        each = lambda keys: keys.join(F.broadcast(large), "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "key").groupBy("host", "chunk")
        tally = "host string, key long, n long"
        asked = chunked.groupBy("host", "chunk").applyInArrow(candidates, tally).groupBy("host", "key").agg(F.sum("n").alias("n"))
        summed = chunked.groupBy("host", "chunk").cogroup(each(asked)).applyInArrow(counts, tally).groupBy("host", "key").agg(F.sum("n").alias("n"))
        least = F.udf(lambda n: frame_pages(n, least_pages), "long")
        frames = summed.join(F.broadcast(large.select("host", least("pages").alias("least"))), "host").where("n >= least").select("host", "key")
        done = done.unionByName(chunked.groupBy("host", "chunk").cogroup(each(frames)).applyInArrow(choose, result))
    return done.withColumnsRenamed(dict(zip(names, keep, strict=True)))
