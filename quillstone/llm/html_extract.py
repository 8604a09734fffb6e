"""Main text of web pages: markup and repetition within a host vote on every block.

``parse`` cuts a page into blocks and gives each the vote of its markup.  Text inside menus,
headers, footers, asides, forms, scripts, notices, adverts or comments is ``x`` (excluded);
a class or id excludes by the head noun of its words (not ``has-sidebar``), and neither
an html, body, main or article element nor one that holds the page's main or all its articles;
inside an article (without one: inside ``main``) it is ``m`` (main); on a page that has
such a part all other text is ``o`` (outside), on other pages ``u`` (undecided).

Repetition within the host decides what markup leaves open.  The token streams of a host's
pages, all blocks, are laid end to end and their suffixes put in order to the
depth of ``min_tokens``: suffixes that agree so far are one interval of the suffix array,
and an interval that holds suffixes of distinct pages is a long repeated substring.  All
tokens under one are repeated.  No host is one task's work: a suffix is looked at only
where its *anchor* (of the token grams in its first ``min_tokens`` tokens the one of least
hash) stands on distinct pages of the host, and intervals are groups of suffixes with
equal first tokens, built over ranges of hashes.  First tokens are compared by 96 bits of
BLAKE2b, anchors by 40 (a false meeting costs a comparison), and every page of the host counts.
Anchors and suffixes cross to their range packed: sorted, as differences, a column of bytes
after the other.  Texts never cross: pages are kept in *slices* that tables of places are
brought to.

Pages of equal open text are one page to the array.  A page of whose open text ``COPY`` or more is
repeated is a copy of others, as an article under several addresses is: of its repeats only
those count that stand on more pages than most of its text does, so that its own text
is no boilerplate.  A block of role ``u`` of which half is repeated keeps its unique runs only;
one that is mostly unique stays whole, as articles quote one another.  Blocks of role ``o`` go.  Blocks of role
``m`` are never cut: what two articles share is still each one's text.

Defined results.  Null html is an empty page with empty text.  A null or odd url
gives the empty host.  White space is what str.split() splits at.  End tags that HTML
implies (p, li, table cells) are implied; other markup that is never closed ends with its
parent; a comment or script that is never closed runs to the end of the page.  Parsing
takes time in proportion to the page.  Pages of any length are read whole.  Repeated rows
of one identifier each keep their row.  An empty table gives an empty result.  Only the
three named columns are read.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quillstone.llm.rows import as_batch
from quillstone.sources.workspace import fresh_path, materialise, settings

#: A comment, a declaration, or a tag: slash, name, and if its end is found at once the rest.
MARKUP = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)(?:[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>)?|!--|[!?])""")
#: The same where no more quotes close.
SIMPLE = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)(?:[^>]*+>)?|!--|[!?])")
QUOTE_OR_END = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)

RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in "script style noscript template iframe textarea select title".split()}
EXCLUDED = frozenset("head nav aside form button dialog menu".split())
#: Excluded outside an article; inside one they hold its title and notes.
OUTER = frozenset(("header", "footer"))
#: Elements whose end tag may be left out, by kind; one closes the open one of its kind.
IMPLIED = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "td": "td", "th": "td", "tr": "tr", "option": "option"}
#: Opening tags that close an open p.
CLOSES_P = frozenset("address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
#: Elements across which nothing is implied, by kind.
SCOPES = {"table": ("p", "td", "tr", "li", "dt"), "td": ("p", "li", "dt"), "th": ("p", "li", "dt"), "button": ("p",), "ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt",), "select": ("option",)}
#: Kinds that an opening tag closes, and those it opens or (True) shuts off.
CLOSES = {name: (*(["p"] if name in CLOSES_P else []), *([IMPLIED[name]] if name in IMPLIED and name != "p" else [])) for name in CLOSES_P | IMPLIED.keys()}
OPENS = {name: (*([(IMPLIED[name], False)] if name in IMPLIED else []), *((kind, True) for kind in SCOPES.get(name, ()))) for name in IMPLIED.keys() | SCOPES.keys()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block; all others, unknown ones too, run on within it.
BREAKS = CLOSES_P | frozenset("html head body br caption center dd dialog dir dt frameset hgroup legend li listing noframes optgroup search summary tbody td tfoot th thead tr xmp".split())
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs cookie cookies consent gdpr notice notices alert comment comments disqus respond share sharing social related recommended newsletter "
    "subscribe subscription signup popup modal overlay toolbar pagination pager widget login search skip".split()
)
#: Of them, those whose elements hold articles of others.
LISTS = frozenset("comment comments disqus respond related recommended".split())
#: First parts of class words that tell of a page's layout, not of the element.
LAYOUT = frozenset("has with without no hide".split())
#: Last parts that leave the meaning to the part before: comment-list, ad-slot, cookie-bar.
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons container desktop form group header icon icons inner item items left link links list mobile outer panel "
    "primary right row secondary section slot title top unit wrap wrapper".split()
)
#: Never judged by class or id.
WHOLE = frozenset("html body main article".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

#: The share of repeated open text from which a page is a copy.
COPY = 0.95
#: Tokens of a gram, by whose hash suffixes are picked for comparison.
GRAM = 3

#: Characters of a slice of pages, about; a longer page is a slice of its own.
SLICE = 1 << 22
#: Anchors or suffixes of pages that are packed together, about.
PACK = 1 << 19
#: Characters of all pages for one range of hashes.
RANGE = 1 << 23
#: A written table's shuffle files go with its job.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("roles", pa.string()), ("blocks", pa.string()), ("content", pa.int64()), ("slice", pa.int64()), ("row", pa.int64())])
PACKED = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), ("n", pa.int64()), ("entries", pa.binary())])
CONTEXT = pa.schema([("slice", pa.int64()), ("row", pa.int64()), ("back", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
REPEAT = pa.schema([("slice", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
RESULT = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_repeated", pa.int64()), ("n_removed", pa.int64())]
)


def head_nouns(value: str) -> set[str]:
    """Of each class word the whole and the part that says what the element is."""
    found = set()
    for word in value.split():
        parts = [p for p in re.split("[_-]+", word) if p and not p[0].isdigit()]
        if not parts or parts[0] in LAYOUT:
            continue
        found |= {word, parts[-1]}
        while len(parts) > 1 and parts[-1] in NEUTRAL:
            parts.pop()
        found.add(parts[-1])
    return found


def judge_tag(name: str, attributes: str, in_article: bool) -> str:
    """x, a (article), m (main) or an empty string for an opening tag; s or l where only
    its class or id marks it, l if the mark is one of LISTS."""
    if name in EXCLUDED or (name in OUTER and not in_article):
        return "x"
    verdict = "a" if name == "article" else "m" if name == "main" else ""
    marked = ""
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            if name not in WHOLE:
                words = head_nouns(value)
                if not LISTS.isdisjoint(words):
                    marked = "l"
                elif not MARKS.isdisjoint(words) or not (in_article or OUTER.isdisjoint(words)):
                    marked = marked or "s"
        elif key == "role":
            if value in ROLES_OUT:
                return "x"
            verdict = verdict or {"article": "a", "main": "m"}.get(value, "")
        elif key == "itemprop":
            verdict = "a" if value == "articlebody" else verdict
        elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "x"
    return verdict or marked


def tokens(html: str) -> Iterator[tuple[str, str, str, str]]:
    """text, a closing tag's slash, name of the tag, attributes; any of them may be empty.

    Comments and declarations are left out.  Linear: where quotes do not close, the rest of
    the page is scanned for that once.
    """
    at, end, markup = 0, len(html), MARKUP
    while tag := markup.search(html, at):
        start, stop = tag.span()
        slash, name = tag.groups()
        if name:
            rest = tag.end(2)
            if stop == rest:
                stop = -1 if markup is SIMPLE else unquoted_end(html, rest)
                if stop < 0:
                    if markup is SIMPLE:
                        break
                    markup = SIMPLE
                    continue
            name = name.lower()
            yield html[at:start], slash, name, html[rest : stop - 1]
            if name in RAW and not slash and html[stop - 2] != "/":
                done = RAW[name].search(html, stop)
                stop = done.end() if done else end
        elif stop - start == 4:
            done = html.find("-->", stop)
            stop = end if done < 0 else done + 3
            yield html[at:start], "", "", ""
        else:
            stop = html.find(">", stop) + 1
            if not stop:
                break
            yield html[at:start], "", "", ""
        at = stop
    yield html[at:], "", "", ""


def unquoted_end(html: str, at: int) -> int:
    """Where the tag ends, after its >; -1 if every > stands in quotes."""
    while True:
        found = QUOTE_OR_END.search(html, at)
        if not found:
            return -1
        if found[0] == ">":
            return found.end()
        close = html.find(found[0], found.end())
        at = found.end() if close < 0 else close + 1


class Tree:
    """The open elements of a page while it is read."""

    def __init__(self):
        self.names: list[str] = []
        self.verdicts: list[str] = []
        self.open: dict[str, int] = defaultdict(int)  # by name
        self.count = dict.fromkeys(("", "x", "a", "m", "s", "l"), 0)  # by verdict
        self.implied: dict[str, list[int]] = defaultdict(list)  # by kind: places of open ones, -1 for a scope
        self.marks: list[list] = []  # marked elements: kind, [articles, mains] at start and end, the mark around
        self.mark = -1
        self.seen = [0, 0]

    def push(self, name: str, verdict: str) -> None:
        for kind, scope in OPENS.get(name, ()):
            self.implied[kind].append(-1 if scope else len(self.names))
        self.names.append(name)
        self.verdicts.append(verdict)
        self.open[name] += 1
        self.count[verdict] += 1
        if verdict and verdict in "sl":
            self.marks.append([verdict, self.seen.copy(), self.seen, self.mark])
            self.mark = len(self.marks) - 1
        elif verdict and not self.count["x"]:
            self.seen[0] += verdict == "a" and not self.count["l"]
            self.seen[1] += verdict == "m"

    def pop(self) -> str:
        name, verdict = self.names.pop(), self.verdicts.pop()
        for kind, _ in OPENS.get(name, ()):
            self.implied[kind].pop()
        self.open[name] -= 1
        self.count[verdict] -= 1
        if verdict and verdict in "sl":
            self.marks[self.mark][2] = self.seen.copy()
            self.mark = self.marks[self.mark][3]
        return name

    def close(self, name: str, flush: Callable[[], None]) -> None:
        """Close the element and what is open in it; ``flush`` comes before each that ends a block."""
        while self.open.get(name):
            if self.verdicts[-1] or self.names[-1] in BREAKS:
                flush()
            if self.pop() == name:
                break

    def imply(self, name: str) -> None:
        """Close what an opening tag of that name closes."""
        for kind in CLOSES[name]:
            places = self.implied[kind]
            while places and places[-1] >= 0:
                self.pop()

    def role(self) -> str:
        return "x" if self.count["x"] else "a" if self.count["a"] else "m" if self.count["m"] else "u"


def parse(html: str) -> tuple[str, list[str]]:
    """Roles (one letter a block) and texts of a page's blocks, in page order."""
    tree, found, piece = Tree(), [], []  # found: role, text, innermost mark

    def close_block() -> None:
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            if text:
                found.append((tree.role(), text, tree.mark))
            piece.clear()

    for text, slash, name, attributes in tokens(html):
        if text:
            piece.append(text)
        if not name:
            continue
        if piece and name in BREAKS:
            close_block()
        if slash:
            tree.close(name, close_block)
        else:
            if name in CLOSES:
                tree.imply(name)
            if name not in VOID and name not in RAW:
                verdict = judge_tag(name, attributes, tree.count["a"] > 0)
                if verdict:
                    close_block()
                tree.push(name, verdict)
    close_block()
    # A mark does not count around a main, or around all articles unless it is of LISTS.
    out: list[bool] = []
    for kind, start, end, around in tree.marks:
        own = end[1] == start[1] and (kind == "l" or end[0] - start[0] < max(1, tree.seen[0]))
        out.append(own or (around >= 0 and out[around]))
    roles = ["x" if mark >= 0 and out[mark] else role for role, _, mark in found]
    main = "a" if "a" in roles else "m"
    final = ["m" if r == main else "x" if r == "x" else "u" for r in roles]
    if "m" in final:
        final = ["o" if r == "u" else r for r in final]
    return "".join(final), [text for _, text, _ in found]


def parse_row(page_id, url, html) -> Iterator[tuple]:
    roles, blocks = parse(html or "")
    yield page_id, url, roles, "\n".join(blocks), signed_hash("\n".join(b for r, b in zip(roles, blocks, strict=True) if r != "x"))


def signed_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def joined(pages: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of pages as one text of tokens between spaces: it, where tokens begin and end, and each page's first token (of all, too)."""
    sizes = [b.count(" ") + b.count("\n") + 1 if b else 0 for b in pages]
    text = " ".join(filter(None, pages)).replace("\n", " ").encode("utf-8", "surrogatepass")
    if not text:
        return text, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(pages) + 1, np.int64)
    space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return text, np.append(0, space + 1), np.append(space, len(text)), np.cumsum([0, *sizes])


def powers(base: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [base] * (1 << 16), np.uint64))


#: An odd number's powers modulo 2**64, those of its inverse, and a number for each byte but the space.
UP, DOWN = powers(0x9E3779B97F4A7C15), powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = np.array([0 if b == 32 else xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def token_hashes(text: bytes, begin: np.ndarray) -> np.ndarray:
    """64 bits of every token, of its bytes only: sums of bytes by powers of their place, taken a stretch at a time."""
    data, stretch = np.frombuffer(text, np.uint8), len(UP) - 1
    before, scale = np.zeros(len(begin) + 1, np.uint64), np.empty(len(begin), np.uint64)
    total, up, down, i = np.zeros(1, np.uint64), UP[:1], DOWN[:1], 0
    for at in range(0, len(data), stretch):
        part = BYTES[data[at : at + stretch]] * UP[: min(stretch, len(data) - at)]
        sums = np.cumsum(part)
        j = i + int(np.searchsorted(begin[i:], at + stretch))
        own = begin[i:j] - at
        before[i:j] = total + up * (sums[own] - part[own])
        scale[i:j] = down * DOWN[own]
        total, up, down, i = total + up * sums[-1:], up * UP[-1:], down * DOWN[-1:], j
    before[-1:] = total
    h = np.diff(before) * scale
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def contexts(text: bytes, begin: np.ndarray, page: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors, first windows, numbers of windows: runs of windows, each within a page, that share their anchor; ``page`` are first tokens."""
    if len(begin) < min_tokens:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = min(GRAM, min_tokens)
    h = token_hashes(text, begin)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        grams = (grams * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + len(grams)]
    grams ^= grams >> np.uint64(31)
    n = len(h) - min_tokens + 1
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, min_tokens - gram + 1):
        np.putmask(at, grams[k : k + n] < least, k)
        np.minimum(least, grams[k : k + n], out=least)
    inside = np.ones(len(h), bool)
    for k in range(1, min_tokens):
        inside[np.maximum(page[1:] - k, page[:-1])[page[1:] > page[:-1]]] = False
    start = np.flatnonzero(inside[:n])
    at = at[start] + start
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[first]], start[first], np.diff(first, append=len(at))


def anchors(pages: pa.RecordBatch, copies: dict[str, np.ndarray], min_tokens: int) -> np.ndarray:
    """Entries (hash of host and anchor, number of windows, row, lead, start) of pages."""
    text, begin, _, page = joined(pages["blocks"].to_pylist())
    grams, start, windows = contexts(text, begin, page, min_tokens)
    row, back = pages["row"].to_numpy(), np.zeros(len(pages), np.int64)
    _, some, of = np.intersect1d(row, copies["row"], return_indices=True)
    back[some] = copies["back"][of]
    salt = np.array([xxhash.xxh3_64_intdigest(h.encode("utf-8", "surrogatepass")) for h in pages["host"].to_pylist()], np.uint64)
    on = np.searchsorted(page, start, side="right") - 1
    key = (grams ^ salt[on]) * np.uint64(0x9E3779B97F4A7C15)
    return entries(key >> np.uint64(24) << np.uint64(24), windows, row[on], back[on], start - page[on])


def suffixes(pages: pa.RecordBatch, own: dict[str, np.ndarray], min_tokens: int) -> np.ndarray:
    """Entries (64 bits and 32 more of the digest of host and first tokens, row, lead, start) of pages' given contexts."""
    row = pages["row"].to_numpy()
    low, high = np.searchsorted(own["row"], row), np.searchsorted(own["row"], row, side="right")
    pages = pages.filter(pa.array(low < high))
    row, low, high = (c[low < high] for c in (row, low, high))
    if not len(row):
        return np.empty((5, 0), np.uint64)
    text, begin, end, page = joined(pages["blocks"].to_pylist())
    of = ramps(low, high - low)
    windows = own["windows"][of]
    start = ramps(own["start"][of], windows)
    on, of = (np.repeat(a, windows) for a in (np.repeat(np.arange(len(row)), high - low), of))
    salts = [md5(h.encode("utf-8", "surrogatepass")).digest() for h in pages["host"].to_pylist()]
    places = zip(begin[page[on] + start].tolist(), end[page[on] + start + min_tokens - 1].tolist(), on.tolist(), strict=True)
    both = np.frombuffer(b"".join([blake2b(text[i:j], digest_size=12, salt=salts[k]).digest() for i, j, k in places]), np.dtype([("key", "<u8"), ("more", "<u4")]))
    return entries(both["key"], both["more"], row[on], own["back"][of], start)


def ramps(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 and on, n of them, for each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def entries(*columns: np.ndarray) -> np.ndarray:
    """Columns key, more, row, back (lead - row: zero but for copies) and start, as bits."""
    return np.stack([c if c.dtype == np.uint64 else c.astype(np.int64).view(np.uint64) for c in columns])


def packed(found: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Rows of PACKED, one for each of 2**bits ranges of the key: entries in order, as differences, byte by byte."""
    e = np.concatenate(found, axis=1)
    e = e[:, np.lexsort((e[1], e[0]))]
    base = e[2].min()
    e[2] -= base
    bucket = (e[0] >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    rows = []
    for i, j in zip(first, [*first[1:], len(bucket)], strict=True):
        some = e[:, i:j].copy()
        some[0, 1:] -= e[0, i : j - 1]
        planes = some.view(np.uint8).reshape(5, j - i, 8).transpose(0, 2, 1).tobytes()
        rows.append((int(bucket[i]), int(base), j - i, pa.compress(planes, "zstd", asbytes=True)))
    return as_batch(rows, PACKED)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """key, more, row, back, start of all entries of rows of PACKED."""
    n = np.array(rows.column("n").to_pylist(), np.int64)
    found, at = np.zeros((5, n.sum()), np.uint64), 0
    for base, size, data in zip(*(rows.column(c).to_pylist() for c in ("base", "n", "entries")), strict=True):
        planes = np.frombuffer(pa.decompress(data, 40 * size, "zstd"), np.uint8)
        some = found[:, at : at + size]
        some[:] = np.ascontiguousarray(planes.reshape(5, 8, size).transpose(0, 2, 1)).view(np.uint64)[..., 0]
        some[0] = np.cumsum(some[0], dtype=np.uint64)
        some[2] += np.uint64(base)
        at += size
    return found[0], found[1], *found[2:].astype(np.int64)


def packing(bits: int, find: Callable[[pa.RecordBatch, dict[str, np.ndarray]], np.ndarray]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Packs what ``find`` says of some pages of a slice, and of what is known of its places, by row."""

    def run(pages: pa.Table, known: pa.Table) -> pa.Table:
        known = by_row(known)
        found, held, out = [], 0, []
        for batch in pages.to_batches(64):
            found.append(find(batch, known))
            held += found[-1].shape[1]
            if held >= PACK:
                out.append(packed(found, bits))
                found, held = [], 0
        if held:
            out.append(packed(found, bits))
        return pa.Table.from_batches(out, PACKED)

    return run


def by_row(known: pa.Table) -> dict[str, np.ndarray]:
    """The columns in order of row; no number is -1."""
    columns = {c: known[c].fill_null(-1).to_numpy() for c in known.column_names}
    order = np.argsort(columns["row"], kind="stable")
    return {c: v[order] for c, v in columns.items()}


def shared(rows: pa.Table) -> pa.Table:
    """Rows of CONTEXT: entries whose anchor stands on pages of distinct content."""
    key, windows, row, back, start = unpacked(rows)
    order = np.argsort(key, kind="stable")
    lead = (row + back)[order]
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    many = np.minimum.reduceat(lead, first) < np.maximum.reduceat(lead, first)
    at = order[np.repeat(many, np.diff(first, append=len(order)))]
    at = at[np.argsort(row[at], kind="stable")]
    return pa.table([row[at] >> 20, row[at], back[at], start[at].astype(np.int32), windows[at].astype(np.int32)], schema=CONTEXT)


def intervals(rows: pa.Table) -> pa.Table:
    """Rows of REPEAT: suffixes whose first tokens pages of distinct content have, and how many contents (n)."""
    key, more, row, back, start = unpacked(rows)
    order = np.lexsort((row + back, more, key))
    key, more, lead = key[order], more[order], (row + back)[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    other = new.copy()
    other[1:] |= lead[1:] != lead[:-1]
    first = np.flatnonzero(new)
    n = np.repeat(np.add.reduceat(other.astype(np.int64), first), np.diff(first, append=len(order)))
    at, n = order[n > 1], n[n > 1]
    by = np.lexsort((start[at], row[at]))
    at, n = at[by], n[by]
    return pa.table([row[at] >> 20, row[at], start[at].astype(np.int32), n.astype(np.int32)], schema=REPEAT)


def by_slice(parsed: DataFrame, columns: list[str], known: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], out: pa.Schema) -> DataFrame:
    """``run`` on each slice of pages with the known places in it; only these are shuffled."""
    return parsed.select("slice", *columns).groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(run, from_arrow_schema(out))


def repeated(parsed: DataFrame, min_tokens: int) -> DataFrame:
    """slice, row, start, n: of each page the suffixes whose first tokens another page of the host has, and on how many pages (n) they stand."""
    size = parsed.agg(F.sum("size")).first()[0] or 0
    bits = max(4, int(size // RANGE).bit_length())
    first = parsed.groupBy("host", "content").agg(F.min("row").alias("lead"), F.max("row").alias("last")).filter("lead < last")
    back = parsed.select("host", "content", "slice", "row").join(first, ["host", "content"]).select("slice", "row", (F.col("lead") - F.col("row")).alias("back"))
    back = materialise(back, "page-copies", compression="zstd")
    page = ["row", "host", "blocks"]
    every = by_slice(parsed, page, back, packing(bits, lambda p, copies: anchors(p, copies, min_tokens)), PACKED)
    own = materialise(every.groupBy("bucket").applyInArrow(shared, from_arrow_schema(CONTEXT)), "page-contexts", compression="zstd")
    found = by_slice(parsed, page, own, packing(bits, lambda p, own: suffixes(p, own, min_tokens)), PACKED)
    return found.groupBy("bucket").applyInArrow(intervals, from_arrow_schema(REPEAT))


def settle_row(page_id, url, roles, blocks, repeats: tuple[np.ndarray, np.ndarray] | None, min_tokens: int) -> Iterator[tuple]:
    """The page's text from both votes; ``repeats`` are the starts of repeated suffixes and on how many pages they stand."""
    texts = blocks.split("\n") if roles else []
    sizes = np.array([t.count(" ") + 1 for t in texts], np.int64)
    total = int(sizes.sum())
    if repeats is None or not len(repeats[0]):
        yield page_id, url, "\n".join([t for role, t in zip(roles, texts, strict=True) if role in "mu"]), total, 0, 0
        return
    pages = np.zeros(total, np.int64)  # of each token, the most pages that a repeat over it stands on
    np.maximum.at(pages, np.add.outer(np.arange(min_tokens), repeats[0]).ravel(), np.tile(repeats[1].astype(np.int64), min_tokens))
    covered = counts = pages > 0
    if "u" in roles:
        open_pages = pages[np.repeat([r != "x" for r in roles], sizes)]
        if (open_pages > 0).mean() >= COPY:
            counts = pages > np.quantile(open_pages[open_pages > 0], 0.1, method="lower")
    end = np.cumsum(sizes)
    seen, hits = (np.add.reduceat(c, end - sizes, dtype=np.int64).tolist() for c in (covered, counts))
    kept, removed = [], 0
    for role, text, at, n, was, hit in zip(roles, texts, (end - sizes).tolist(), sizes.tolist(), seen, hits, strict=True):
        if role in "xo":
            removed += was
            continue
        if role == "u" and 2 * hit >= n:
            removed += hit
            text = " ".join([w for w, h in zip(text.split(" "), counts[at : at + n].tolist(), strict=True) if not h])
        if text:
            kept.append(text)
    yield page_id, url, "\n".join(kept), total, int(covered.sum()), removed


def host_of(url: str):
    """The host of an absolute url in lower case, without user and port; else empty."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_texts(pages: DataFrame, min_tokens: int = 8, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_tokens (of all blocks), n_repeated (of them,
    under repeated substrings), n_removed (of those, left out of the text).

    Repetition is looked for on every host.  Where markup leaves no page of the host open,
    no verdict waits for it, and n_removed is null.
    """
    parsed = parsed_pages(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    with settings(pages.sparkSession, CLEAN):
        starts = materialise(repeated(parsed, min_tokens), "page-repeats", compression="zstd")
        # A row without a start says that the page's host is one that has an open page.
        waiting = parsed.filter("contains(roles, 'u')").select("host").distinct()
        looked = materialise(parsed.select("host", "slice", "row").join(waiting, "host").selectExpr("slice", "row", "CAST(NULL AS int) AS start", "CAST(NULL AS int) AS n"), "page-looked", compression="zstd")

    def run(pages: pa.Table, known: pa.Table) -> pa.Table:
        places = by_row(known.select(["row", "start", "n"]))
        looked = set(places["row"][places["start"] < 0].tolist())
        row, start, n = (c[places["start"] >= 0] for c in places.values())
        out = []
        for batch in pages.to_batches(256):
            low, high = (np.searchsorted(row, batch["row"].to_numpy(), side=side).tolist() for side in ("left", "right"))
            rows = []
            for p, i, j in zip(batch.to_pylist(), low, high, strict=True):
                for found in settle_row(p["page_id"], p["url"], p["roles"], p["blocks"], (start[i:j], n[i:j]), min_tokens):
                    rows.append(found if p["row"] in looked else (*found[:5], None))
            out.append(as_batch(rows, RESULT))
        return pa.Table.from_batches(out, RESULT)

    return by_slice(parsed, ["row", "page_id", "url", "roles", "blocks"], starts.union(looked), run, RESULT)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """PARSED, host and size (characters of the blocks) of pages (page_id, url, html), written in buckets of slices, before anything reads the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 22
        part, row, size = 0, 0, 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for values in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    for found in parse_row(*values):
                        if row and (size + len(found[3]) > SLICE or row == 1 << 20):
                            part, row, size = part + 1, 0, 0
                        rows.append((*found, task + part, (task + part << 20) + row))
                        row, size = row + 1, size + len(found[3])
                yield as_batch(rows, PARSED)

    spark = pages.sparkSession
    parsed = pages.mapInArrow(run, from_arrow_schema(PARSED)).withColumns({"host": host_of("url"), "size": F.length("blocks").cast("long")})
    path, name = fresh_path(spark, "pages-parsed"), f"pages_parsed_{uuid.uuid4().hex}"
    parts = min(pages.rdd.getNumPartitions(), 100_000)  # Spark's most buckets
    parsed.write.bucketBy(max(1, parts), "slice").options(path=path, compression="zstd").saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved: the files are read by path, the name is not needed  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return found
