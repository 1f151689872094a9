"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host, URL path, query, id and digest over ranges of that order, so that a host with very many
pages is spread over many tasks. Each page is compared with the pages next to it in that order, SIDE before it and SIDE
after it, of its own host. Pages in a row with the same lines at the same places count as one, and a neighbour with the
same words is left out, as the same article under two addresses says nothing of what a site repeats. The lines of both pages are aligned by a longest
common subsequence; a line that half of the neighbours or more share is what the site repeats, and is deleted.

Menus, adverts and footers vary in their words from page to page, so words alone don't align them. The markup gives each
line its place: GONE (inside an element, role or class name for menus, headers, footers, asides, notices, adverts,
forms, comments), MAIN (inside an article or main element) or OPEN. A GONE line is aligned by its place, any other by its
text. Where a page has neighbours, their vote decides:

- OPEN lines go if they are shared and stay if not, also beside an article;
- a MAIN line stays, shared or not, as articles repeat passages of their own;
- a GONE line that is not shared goes by its place.

On a page without neighbours places decide alone: GONE lines go, and OPEN ones where there is an article. n_shared,
n_by_place and n_tied say how many lines each rule decided.

The ranges do not show in the result. A first pass orders addresses and digests alone and tells of each range where it
begins and which pages stand at its edges; from that the driver, which gets 2 (SIDE + 1) rows of a range at most, finds
the differing pages on either side of each range. Those pages are sent to the range besides its own.

Defined cases: null or empty html gives an empty text; a null url pairs with nothing, and a page without neighbours is
decided by its places alone; repeated rows share their neighbours; ties in the order of pages are equal rows; markup
that is never closed ends with the page, and a tag that has no end is text; a very long page takes time in proportion
to its bytes, and to the product of the line numbers over 64 where two long pages are aligned; columns besides the key,
url and html are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from html import unescape
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.llm.util import ARROW_ROWS, materialize, small_batches

GONE, OPEN, MAIN = 0, 1, 2
#: Differing pages of the host that a page is compared with on either side of it.
SIDE = 2
#: Letters of a place's name that count; deeper elements have the place of their ancestors.
MOST_PATH = 200
#: Bits of the rows that an alignment holds at once.
MOST_BITS = 1 << 28

#: Fixed word lists of the markup language and of common class names.
RAW = "script|style|noscript|template|textarea|select|iframe|svg|object|title|button"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("b i em strong u s small font code sub sup mark abbr cite q tt big kbd var ins del label time bdi bdo dfn data".split())
TRACKED_INLINE = frozenset(("a", "span"))
LOOSE = frozenset("p li dt dd tr td th a span option h1 h2 h3 h4 h5 h6".split())
GONE_TAGS = frozenset("nav footer aside form dialog menu".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
GONE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "sidebar sidenav widget widgets related recommended menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond share sharing social login signup pagination pager toolbar skip hidden".split()
)

#: The rest of a tag. It ends at the next < outside quotes, so that tags without an end are not read again from every <.
REST = r"((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{REST}.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+){REST}|<[!?][^<>]*+>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
#: Words that say of a page part that another one is there or not.
ABOUT = frozenset("has no with without not is".split())


def _attributes_say_gone(attributes: str, outside: bool) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        value, name = value.strip("\"'"), name.lower()
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in PARTS.split(one)]
                if words[0] not in ABOUT and (not GONE_NAMES.isdisjoint(words) or outside and "header" in words):
                    return True
        elif name == "role" and value.lower() in GONE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def lines_of(html: str) -> list[tuple[int, str, str]]:
    """(GONE, OPEN or MAIN; text; names of the open elements from the outermost GONE one on) of each block with text, in page order."""
    out: list[tuple[int, str, str]] = []
    stack: list[tuple[str, int, str]] = []
    where: dict[str, list[int]] = {}  # places of each open tag in the stack, and of all that are not loose
    firm: list[int] = []
    state, path, parts, at = OPEN, "", [], 0

    def close_block() -> None:
        if parts and (text := " ".join(unescape("".join(parts)).split())):
            out.append((state, text, path))
        parts.clear()

    def pop() -> None:
        tag = stack.pop()[0]
        where[tag].pop()
        if firm and firm[-1] == len(stack):
            firm.pop()

    for token in TOKEN.finditer(html):
        if token.start() > at:
            parts.append(html[at : token.start()])
        at = token.end()
        tag = (token[4] or "").lower()
        if not tag:
            if token[1]:
                close_block()
            continue
        if tag in INLINE:
            continue
        if tag not in TRACKED_INLINE:
            close_block()
        if token[3]:
            own = where.get(tag)
            if own and not (tag in LOOSE and firm and firm[-1] > own[-1]):
                for _ in range(len(stack) - own[-1]):
                    pop()
        elif tag not in VOID and not token[5].endswith("/"):
            if tag not in TRACKED_INLINE:
                # an open paragraph ends where the next block begins; so does an item where the next one does
                while stack and (stack[-1][0] in ("p", *TRACKED_INLINE) or tag in LOOSE and stack[-1][0] == tag):
                    pop()
            state, path = stack[-1][1:] if stack else (OPEN, "")
            mine = state
            if tag in GONE_TAGS or tag == "header" and state != MAIN or tag not in ("html", "body") and token[5] and _attributes_say_gone(token[5], state != MAIN):
                mine = GONE
            elif tag in ("article", "main") and state != GONE:
                mine = MAIN
            if tag in TRACKED_INLINE and mine != state:
                close_block()
            where.setdefault(tag, []).append(len(stack))
            if tag not in LOOSE:
                firm.append(len(stack))
            stack.append((tag, mine, f"{path}/{tag}"[:MOST_PATH] if mine == GONE else ""))
        now = stack[-1][1:] if stack else (OPEN, "")
        if now[0] != state:
            close_block()
        if not parts:
            state, path = now
    parts.append(html[at:])
    close_block()
    return out


def keys_of(lines: list[tuple[int, str, str]]) -> list[str]:
    """What lines are aligned by: the place of a GONE one, the text of any other."""
    return [f"\0{path}" if state == GONE else text for state, text, path in lines]


def _advance(rows: list[str], bits: dict[str, int], n: int) -> Iterator[int]:
    """After each row a number whose zero bits are the columns at which the longest common subsequence so far grows."""
    full = now = (1 << n) - 1
    for row in rows:
        if both := now & bits.get(row, 0):
            now = ((now + both) | (now - both)) & full
        yield now


def _bits(columns: list[str]) -> dict[str, int]:
    found: dict[str, bytearray] = {}
    for j, c in enumerate(columns):
        found.setdefault(c, bytearray(len(columns) + 7 >> 3))[j >> 3] |= 1 << (j & 7)
    return {c: int.from_bytes(b, "little") for c, b in found.items()}


def _lengths(rows: list[str], columns: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of rows and of each beginning of columns."""
    *_, last = 0, *_advance(rows, _bits(columns), len(columns))
    grown = np.unpackbits(np.frombuffer(last.to_bytes(len(columns) + 7 >> 3, "little"), np.uint8), bitorder="little")[: len(columns)]
    return np.concatenate([[0], np.cumsum(1 - grown)]) if rows else np.zeros(len(columns) + 1, np.int64)


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of a and b, by bit-parallel rows; long pages are halved so that the rows fit."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)] + [(len(a) - k, len(b) - k) for k in range(1, tail + 1)]
    known = set(b[head : len(b) - tail])
    mine = [i for i in range(head, len(a) - tail) if a[i] in known]
    known = {a[i] for i in mine}
    theirs = [j for j in range(head, len(b) - tail) if b[j] in known]
    work, found = [(mine, theirs)], ends
    while work:
        rows, columns = work.pop()
        if not rows or not columns:
            continue
        x, y = [a[i] for i in rows], [b[j] for j in columns]
        if len(x) > 1 and len(x) * len(y) > MOST_BITS:
            half = len(x) // 2
            cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            work += [(rows[:half], columns[:cut]), (rows[half:], columns[cut:])]
            continue
        table = list(_advance(x, _bits(y), len(y)))
        i, j = len(x), len(y)
        while i and j:
            if table[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or table[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append((rows[i], columns[j]))
    return found


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b."""
    return {i for i, _ in align(a, b)}


KEPT, SHARED, BY_PLACE, TIED = range(4)


def decide(lines: list[tuple[int, str, str]], shared: set[int], voted: bool = False) -> list[int]:
    """For each line the rule that decides it: SHARED and BY_PLACE delete it, KEPT and TIED keep it. shared: lines that neighbours repeat; voted: there are neighbours."""
    article = any(state == MAIN for state, *_ in lines)
    rules = []
    for i, (state, *_) in enumerate(lines):
        if state == MAIN:
            rules.append(TIED if i in shared else KEPT)
        elif i in shared:
            rules.append(SHARED)
        else:
            rules.append(BY_PLACE if state == GONE or article and not voted else KEPT)
    return rules


def repeated(found: list[set[int]]) -> set[int]:
    """Lines that half of the neighbours or more share; found: those shared with each."""
    return {i for i, n in Counter(i for one in found for i in one).items() if 2 * n >= len(found)}


def kept_text(lines: list[tuple[int, str, str]], rules: list[int]) -> str:
    return " ".join(text for (_, text, _), rule in zip(lines, rules) if rule in (KEPT, TIED))


def main_text(lines: list[tuple[int, str, str]], shared: set[int]) -> str:
    return kept_text(lines, decide(lines, shared))


ORDER = ("host", "path", "query", "page_id", "digest")
TYPES = ("string", "string", "string", "bigint", "bigint")


def _address() -> list[Column]:
    """host, path and query of url; empty ones where it has none."""
    address = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)([^#]*)"
    parts = [F.coalesce(F.regexp_extract("url", address, i), F.lit("")) for i in (1, 2, 3)]
    return [F.lower(parts[0]).alias("host"), parts[1].alias("path"), parts[2].alias("query")]


def _edges(rows: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Of ranges of ORDER: where each begins; and (range, place) of the pages before and after it that it is compared with.

    Pages of one host in a row with equal lines are a run; one page stands for it. rows: ORDER and html.
    """
    places = ", ".join(f"{c} {t}" for c, t in zip(ORDER, TYPES))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest_of(lines_of(x or "")) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*ORDER, "lines"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first (0) and last (1) SIDE + 1 runs of the range, as far as they are of its first or last page's host; whole: those are all of it."""
        first, last, whole = [], [], True
        for batch in batches:
            for page in zip(*(c.to_pylist() for c in batch.columns)):
                if last and page[0] == last[-1][0] and page[-1] == last[-1][-1]:
                    continue
                if last and page[0] != last[-1][0]:
                    last, whole = [], False
                if whole and len(first) <= SIDE:
                    first.append(page)
                last.append(page)
                if len(last) > SIDE + 1:
                    last.pop(0)
                    whole = whole and None  # one host still, but with runs that are not told
        told = [(side, whole is True, i, *p) for side, found in enumerate((first, last)) for i, p in enumerate(found)]
        if told:
            columns = [pa.array(c, t) for c, t in zip(zip(*told), (pa.int32(), pa.bool_(), pa.int32(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.binary()))]
            part = pa.array([TaskContext.get().partitionId()] * len(told), pa.int32())
            yield pa.RecordBatch.from_arrays([part, *columns], ["part", "side", "whole", "place", *ORDER, "lines"])

    spark = rows.sparkSession
    keys = materialize(rows.select(*ORDER, "html").mapInArrow(digests, f"{places}, lines binary"), "page-digests")
    dealt = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *ORDER).sortWithinPartitions(*ORDER)
    told: dict[int, tuple[bool, list, list]] = {}
    for part, side, whole, place, *page in sorted(dealt.mapInArrow(ends, f"part int, side int, whole boolean, place int, {places}, lines binary").collect(), key=lambda r: r[:4]):
        told.setdefault(part, (whole, [], []))[1 + side].append((*page[:-1], bytes(page[-1])))
    ranges = [told[p] for p in sorted(told)]
    beside = []
    for i, (_, first, last) in enumerate(ranges):
        for edge, others, far in ((first[0], ranges[:i][::-1], 2), (last[-1], ranges[i + 1 :], 1)):
            lines, lent = edge[-1], 0
            for other in others:
                for page in other[far] if far == 1 else other[far][::-1]:
                    if edge[0] and page[0] == edge[0] and lent < SIDE and page[-1] != lines:
                        beside.append((i, *page[:-1]))
                        lines, lent = page[-1], lent + 1
                if not edge[0] or lent == SIDE or not other[0] or other[far][0][0] != edge[0]:
                    break
    return [first[0][:-1] for _, first, _ in ranges], beside


def digest_of(lines: list[tuple[int, str, str]]) -> bytes:
    return blake2b("\n".join(f"{state}{path} {text}" for state, text, path in lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_lines, n_shared (lines that differencing deletes), n_by_place (that their place deletes), n_tied (shared, but kept by their place), n_neighbours."""
    small_batches(pages.sparkSession)
    counts = ("n_lines", "n_shared", "n_by_place", "n_tied", "n_neighbours")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), *((c, pa.int64()) for c in counts)])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # the last runs of a range and host: [(part, host), digest, lines, keys, [(own, page_id, url)], lines shared with each neighbour]
        near: deque = deque()

        def answer(run: list) -> Iterator[tuple]:
            _, _, lines, _, pages, shared = run
            rules = decide(lines, repeated(shared), bool(shared))
            text = kept_text(lines, rules)
            counted = [len(lines), *(rules.count(x) for x in (SHARED, BY_PLACE, TIED)), len(shared)]
            yield from ((key_, url, text, *counted) for own, key_, url in pages if own)

        for batch in batches:
            for part, own, host, key_, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(html or "")
                place, digest = (part, host), digest_of(lines)
                if host and near and near[-1][:2] == [place, digest]:
                    near[-1][4].append((own, key_, url))
                    continue
                if near and (near[-1][0] != place or len(near) > SIDE):
                    for _ in range(len(near) if near[-1][0] != place else 1):
                        yield from answer(near.popleft())
                run = [place, digest, lines, keys_of(lines), [(own, key_, url)], []]
                if not host:
                    yield from answer(run)
                    continue
                for other in near:
                    if [t for _, t, _ in other[2]] != [t for _, t, _ in lines]:
                        pairs = align(other[3], run[3])
                        other[5].append({i for i, _ in pairs})
                        run[5].append({j for _, j in pairs})
                near.append(run)
        while near:
            yield from answer(near.popleft())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(decided(batches), ARROW_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = pages.select(*_address(), F.col(key).cast("bigint").alias("page_id"), F.xxhash64("html").alias("digest"), "url", "html")
    begins, beside = _edges(rows)
    if begins:
        spark = pages.sparkSession
        place = F.struct(*[F.col(c) for c in ORDER])
        starts = F.array(*[F.struct(*[F.lit(x).cast(t).alias(c) for c, t, x in zip(ORDER, TYPES, start)]) for start in begins])
        known = spark.createDataFrame(beside, ", ".join(["part int", *[f"{c} {t}" for c, t in zip(ORDER, TYPES)]]))
        same = reduce(lambda p, q: p & q, [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ORDER])
        # 2 SIDE rows for each range at most; of repeated rows one is enough
        lent = rows.alias("r").join(F.broadcast(known.alias("k")), same).select("k.part", "r.*").dropDuplicates(["part", *ORDER])
        own = rows.withColumn("part", F.size(F.filter(starts, lambda x: x <= place)) - 1)
        rows = own.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)))
    else:
        rows = rows.select("*", F.lit(0).alias("part"), F.lit(True).alias("own"))
    rows = rows.repartitionByRange("part").sortWithinPartitions("part", *ORDER).select("part", "own", "host", "page_id", "url", "html")
    found = rows.mapInArrow(run, "page_id bigint, url string, text string, " + ", ".join(f"{c} bigint" for c in counts))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), *counts)
