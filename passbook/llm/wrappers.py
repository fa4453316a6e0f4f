"""Operator 11: main text of pages by wrappers, union-free regular expressions inferred per host.

A page is a stream of block tags and texts; inline markup belongs to the text around it. The wrapper
of a host starts from one page. Every next stream is aligned with it, token by token. Where tags do
not match, the search crosses over: if the page's tag comes later in the wrapper, what lies between is
optional; if the wrapper's tag comes later in the page, the page's tokens go in as optional; if
neither comes, both are optional. Equal neighbours, single tags or whole sequences (squares), are
one repeated group, aligned with one another. Where one tag still stands in more than ``APART`` places
among its siblings, all from its first to its last is a repeated group of optionals, so wrappers do not
grow with the number of pages. Texts that differ become slots, equal ones stay. So a wrapper holds
sequences, optional and repeated groups and slots, but never a choice.

Each task folds the pages that it reads into one wrapper per host, so a hot host is one row per task;
two shuffles of these small rows give one wrapper per host. Its places are then rated: nothing in
menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments counts; what stands
in an article comes before what stands in the main part, and that before other slots. Outside both,
texts that are equal on all pages of a host and blocks that are mostly links belong to the template.
Each page is matched with the wrapper of its host; the texts at the best places that it fills are its
main text. Pages are not shuffled while all rated wrappers fit ``BROADCAST`` bytes, which is measured;
beyond that they meet in a join that splits hot hosts.

Null and empty pages give an empty text, as do pages of markup alone. Broken markup is read as
browsers do: unclosed blocks end where their parent ends. A null url is a host of its own. Pages of one
id, and equal pages, are separate rows. Pages may have any length; blocks nested deeper than ``DEPTH``
join the block there. A page alone on its host, or an empty table, needs no other pages. Only page_id,
url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import materialise, text_of
from passbook.operators.skew import salted_left_join

#: Bytes of rated wrappers that one broadcast may hold; depth of blocks; tasks' rows per host that meet first.
BROADCAST, DEPTH, SALTS = 32 << 20, 96, 64
#: Times that a tag may stand apart among its siblings before all between is one loose group; its key.
APART, LOOSE = 3, ("*",)
#: Tokens of wrappers that a task holds before it hands them on.
HELD = 200_000
#: Pages that must agree for a text to be template; share of link text that makes a block a menu.
AGREE, LINKS = 3, 0.5

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/](?![a-zA-Z])[^>]*>?|<[!?][^>]*>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")

# Tag and name lists, plainly: what the elements and usual class names of HTML mean.
BLOCKS = set(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript script style textarea title xmp".split())
SILENT = set("audio button canvas datalist label map math object optgroup option output picture select svg template video".split())
DROPPED = set("aside dialog dir fieldset footer form head menu nav search".split())
CLOSES_P = BLOCKS - {"head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Open elements that a start tag ends, up to the first element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words in class and id: parts of a layout, which may also be said of what holds the article ...
LAYOUT = set("aside banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation pager pagination sidebar toolbar topbar widget widgets".split())
#: ... and what never belongs to an article.
NEVER = set(
    "ad ads advert advertisement advertising adverts alert comment commentlist comments consent cookie cookies disqus gdpr "
    "modal newsletter notice notices notification overlay popup promo promotion recommended related replies reply share "
    "sharing signup social sponsor sponsored subscribe subscription".split()
)
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "search", "dialog": "dialog", "form": "form", "main": "main", "article": "article"}
HOLDERS = {"article", "main"}


def host() -> Column:
    """Host of the column ``url``, in small letters; empty for a null url or one without host."""
    return F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


# ---- token streams ----------------------------------------------------------------------------


def _key(tag: str, attrs: str) -> str:
    """Name of an element in streams: its tag, or what its role says, and telling words of class and id."""
    if "=" not in attrs:
        return tag
    words = set()
    for name, value in ATTRIBUTE.findall(attrs):
        found = [w.lower() for w in WORD.findall(value)]
        name = name.lower()
        if name == "role":
            tag = ROLES.get(found[0], tag) if found else tag
        elif name == "itemprop":
            tag = "article" if found == ["article", "body"] else tag
        else:
            words.update(w for w in found if w in NEVER or w in LAYOUT)
    return ".".join([tag, *sorted(words)])


class Reader:
    """Reads a page into nested streams: ``[key, parts]`` for a block, ``[None, text, links]`` for a text."""

    def __init__(self, page: str):
        self.root: list = []
        self.open = [("", self.root, False)]  # tag, parts, silent
        self.buffer: list[str] = []
        self.silent = self.anchors = self.linked = 0
        at, lower = 0, None
        while at < len(page):
            m = TOKEN.search(page, at)
            self.text(page[at : m.start() if m else len(page)])
            if m is None:
                break
            at = m.end()
            if m["end"]:
                self.end(m["end"].lower())
            elif m["start"]:
                tag = m["start"].lower()
                if tag in RAW:
                    lower = page.lower() if lower is None else lower
                    if len(lower) != len(page):  # some capitals grow in lower case
                        lower = re.sub("[A-Z]+", lambda a: a[0].lower(), page)
                    close = lower.find(f"</{tag}", at)
                    at = len(page) if close < 0 else close
                else:
                    self.start(tag, m["attrs"])
        self.flush()

    def text(self, raw: str) -> None:
        if raw and not self.silent:
            raw = entities.unescape(raw) if "&" in raw else raw
            self.buffer.append(raw)
            self.linked += len(raw) if self.anchors else 0

    def flush(self) -> None:
        if self.buffer:
            text = SPACES.sub(" ", "".join(self.buffer)).strip(" ")
            if text:
                self.open[-1][1].append([None, text, min(self.linked, len(text))])
            self.buffer, self.linked = [], 0

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag == "hr":
            self.flush()
        elif tag in BLOCKS:
            if tag in CLOSES_P:
                self.close({"p"}, BLOCKS - {"p"})
            if tag != "head" and self.open[-1][0] == "head":
                self.pop()
            if tag in ENDS:
                self.close(*ENDS[tag])
            self.flush()
            self.anchors = 0
            key = _key(tag, attrs)
            if len(self.open) <= DEPTH:
                parts: list = []
                self.open[-1][1].append([key, parts])
                self.push(tag, parts, False)
            else:
                self.push(tag, self.open[-1][1], _dropped(key, True))
        elif tag == "body":
            if self.open[-1][0] == "head":
                self.pop()
        elif tag in SILENT or ("=" in attrs and tag not in VOID and NEVER & set(_key(tag, attrs).split(".")[1:])):
            self.push(tag, self.open[-1][1], True)
        elif tag == "a":
            self.anchors = 1

    def push(self, tag: str, parts: list, silent: bool) -> None:
        self.open.append((tag, parts, silent))
        self.silent += silent

    def pop(self) -> None:
        tag, _, silent = self.open[-1]
        if tag in BLOCKS:
            self.flush()
        self.open.pop()
        self.silent -= silent

    def close(self, tags: set[str], stop: set[str]) -> None:
        """Ends the outermost open element of ``tags`` that no element of ``stop`` surrounds."""
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i][0]
            if tag in tags:
                found = i
            elif tag in stop:
                break
        while found and len(self.open) > found:
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "a":
            self.anchors = 0
        if tag in BLOCKS or any(t == tag and s for t, _, s in self.open[-3:]):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == tag:
                    while len(self.open) > i:
                        self.pop()
                    return
            if tag == "p":
                self.flush()


# ---- wrappers ---------------------------------------------------------------------------------


class Part:
    """One place of a wrapper: a text (key None), a block, or a repeated group (key is a tuple of keys)."""

    __slots__ = ("key", "optional", "repeated", "const", "pages", "chars", "links", "parts")

    def __init__(self, key, optional=False, repeated=False, const=None, pages=1, chars=0, links=0, parts=()):
        self.key, self.optional, self.repeated, self.const = key, optional, repeated, const
        self.pages, self.chars, self.links, self.parts = pages, chars, links, list(parts)

    def listed(self) -> list:
        key = list(self.key) if isinstance(self.key, tuple) else self.key
        return [key, self.optional, self.repeated, self.const, self.pages, self.chars, self.links, [p.listed() for p in self.parts]]

    @staticmethod
    def read(row: list) -> Part:
        key = _frozen(row[0]) if isinstance(row[0], list) else row[0]
        return Part(key, *row[1:7], [Part.read(p) for p in row[7]])

    def size(self) -> int:
        return 1 + sum(p.size() for p in self.parts)


def _frozen(key):
    return tuple(_frozen(k) if isinstance(k, list) else k for k in key)


def wrapper_of(stream: list) -> list[Part]:
    """The wrapper of one page."""
    parts = []
    for item in stream:
        if item[0] is None:
            digest = blake2b(item[1].encode("utf-8", "replace"), digest_size=8).hexdigest()  # all that a wrapper asks is whether texts are equal
            parts.append(Part(None, const=digest, chars=len(item[1]), links=item[2]))
        else:
            parts.append(Part(item[0], parts=wrapper_of(item[1])))
    return squares(parts, page=True)


def merge(a: Part, b: Part, page: bool = False) -> Part:
    """Two places of one key as one; ``page`` if both are of the same page."""
    return Part(
        a.key,
        a.optional or b.optional,
        a.repeated or b.repeated,
        a.const if a.const == b.const else None,
        max(a.pages, b.pages) if page else a.pages + b.pages,
        a.chars + b.chars,
        a.links + b.links,
        united([*a.parts, *b.parts], page) if a.key == LOOSE else align(a.parts, b.parts, page),
    )


def united(parts: list[Part], page: bool) -> list[Part]:
    """The members of a loose group: one part per key."""
    found: dict = {}
    for p in parts:
        if isinstance(p.key, tuple):
            for q in united(p.parts, page):
                found[q.key] = merge(found[q.key], q, page) if q.key in found else q
        else:
            found[p.key] = merge(found[p.key], _skipped(p), page) if p.key in found else _skipped(p)
    for p in found.values():
        p.repeated = True
    return list(found.values())


def _fits(group: Part, part: Part) -> bool:
    """Whether a part is all made of members of a loose group."""
    if group.key != LOOSE:
        return False
    return set(_spelt(part)) <= {p.key for p in group.parts}


def _skipped(part: Part) -> Part:
    part.optional = True
    return part


def _places(parts: list[Part]) -> dict:
    found = defaultdict(list)
    for i in range(len(parts) - 1, -1, -1):
        found[parts[i].key].append(i)  # the next one is last
    return found


def _ahead(places: dict, key, at: int) -> int | None:
    """Next place of a key from ``at`` on; places behind are given up for good."""
    found = places.get(key)
    while found and found[-1] < at:
        found.pop()
    return found[-1] if found else None


def _taken(group: Part, parts: list[Part], at: int) -> int:
    """How many of the next parts are one pass of a group."""
    count = len(group.key) if isinstance(group.key, tuple) else 0
    return count if count and tuple(p.key for p in parts[at : at + count]) == group.key else 0


def align(a: list[Part], b: list[Part], page: bool = False) -> list[Part]:
    """Aligns two streams; mismatches become optional, neighbours that repeat become groups."""
    if not a or not b:
        return [_skipped(p) for p in a or b]
    if len(a) == len(b) == 1 and a[0].key == b[0].key:
        return [merge(a[0], b[0], page)]
    out, i, j = [], 0, 0
    in_a, in_b = _places(a), _places(b)
    while i < len(a) and j < len(b):
        if a[i].key == b[j].key:
            out.append(merge(a[i], b[j], page))
            i, j = i + 1, j + 1
        elif _fits(a[i], b[j]):
            a[i].parts = united([*a[i].parts, b[j]], page)
            j += 1
        elif _fits(b[j], a[i]):
            b[j].parts = united([*b[j].parts, a[i]], page)
            i += 1
        elif n := _taken(a[i], b, j):
            a[i] = merge(a[i], Part(a[i].key, pages=b[j].pages, parts=b[j : j + n]), page)
            j += n
            if not _taken(a[i], b, j):
                out.append(a[i])
                i += 1
        elif n := _taken(b[j], a, i):
            b[j] = merge(Part(b[j].key, pages=a[i].pages, parts=a[i : i + n]), b[j], page)
            i += n
            if not _taken(b[j], a, i):
                out.append(b[j])
                j += 1
        else:
            to_a, to_b = _ahead(in_a, b[j].key, i), _ahead(in_b, a[i].key, j)
            if to_a is not None and (to_b is None or to_a - i <= to_b - j):
                out += map(_skipped, a[i:to_a])
                i = to_a
            elif to_b is not None:
                out += map(_skipped, b[j:to_b])
                j = to_b
            else:
                out += [_skipped(a[i]), _skipped(b[j])]
                i, j = i + 1, j + 1
    out += map(_skipped, [*a[i:], *b[j:]])
    return squares(out, page)


def squares(parts: list[Part], page: bool = False) -> list[Part]:
    """Puts neighbours that repeat into one place, then sequences that repeat into groups, until none is left."""
    while len(parts) > 1:
        out: list[Part] = []
        for p in parts:
            if out and out[-1].key == p.key:
                out[-1] = merge(out[-1], p, page)
                out[-1].repeated = True
            else:
                out.append(p)
        keys = [p.key for p in out]
        if len(set(keys)) == len(keys):
            return loosened(out, page)
        after = dict[int, int]()
        last: dict = {}
        for i in range(len(out) - 1, -1, -1):
            after[i] = last.get(keys[i], len(out))
            last[keys[i]] = i
        parts, i = [], 0
        while i < len(out):
            n = after[i] - i
            if i + 2 * n <= len(out) and keys[i : i + n] == keys[i + n : i + 2 * n]:
                group = Part(tuple(keys[i : i + n]), repeated=True, pages=max(p.pages for p in out[i : i + n]), parts=out[i : i + n])
                i += n
                while keys[i : i + n] == list(group.key):
                    group.parts = [merge(x, y, page) for x, y in zip(group.parts, out[i : i + n], strict=True)]
                    i += n
                parts.append(group)
            else:
                parts.append(out[i])
                i += 1
        if len(parts) == len(out):
            break
    return loosened(parts, page)


def _spelt(part: Part) -> list:
    return [k for p in part.parts for k in _spelt(p)] if isinstance(part.key, tuple) else [part.key]


def loosened(parts: list[Part], page: bool) -> list[Part]:
    """Makes one loose group of all that lies between the places of tags that stand in too many."""
    if len(parts) <= APART:
        return parts
    at = defaultdict(set)
    for i, p in enumerate(parts):
        for key in _spelt(p):
            at[key].add(i)
    often = [i for found in at.values() if len(found) > APART for i in found]
    if not often:
        return parts
    a, b = min(often), max(often) + 1
    group = Part(LOOSE, repeated=True, pages=max(p.pages for p in parts[a:b]), parts=united(parts[a:b], page))
    return [*parts[:a], group, *parts[b:]]


def _dropped(key: str, in_article: bool) -> bool:
    tag, *words = key.split(".")
    return tag in DROPPED or (tag == "header" and not in_article) or any(w in NEVER or (w in LAYOUT and not (in_article and w == "header")) for w in words)


def _holds(part: Part) -> bool:
    """Whether an article or main part, itself in no dropped place, lies inside."""
    for p in part.parts:
        if isinstance(p.key, tuple):
            if _holds(p):
                return True
        elif p.key is not None:
            tag, *words = p.key.split(".")
            if not (set(words) & NEVER or tag in DROPPED) and (tag in HOLDERS or _holds(p)):
                return True
    return False


def rated(parts: list[Part], pages: int, rank: int = 3) -> list:
    """``[key, rank, parts]`` per place: 1 in an article, 2 in the main part, 3 elsewhere, 0 never."""
    out = []
    for p in parts:
        if p.key is None:
            template = rank == 3 and ((p.const is not None and p.pages == pages >= AGREE) or p.links > LINKS * p.chars)
            out.append([None, 0 if template else rank, []])
        elif isinstance(p.key, tuple):
            out += rated(p.parts, pages, rank)
        else:
            out.append([p.key, *_rated_block(p, pages, rank)])
    return out


def _rated_block(p: Part, pages: int, rank: int) -> tuple[int, list]:
    tag, *words = p.key.split(".")
    if _dropped(p.key, rank == 1) and not (rank > 1 and tag not in DROPPED and not set(words) & NEVER and _holds(p)):
        return 0, []
    inside = 1 if tag == "article" else min(rank, 2) if tag == "main" else rank
    return inside, rated(p.parts, pages, inside)


# ---- matching ---------------------------------------------------------------------------------


class Places:
    """A rated wrapper, ready to be matched."""

    def __init__(self, rows: list):
        self.rows = [(key, rank, Places(parts)) for key, rank, parts in rows]
        self.at = defaultdict(list)
        for i, row in enumerate(self.rows):
            self.at[row[0]].append(i)

    def texts(self, stream: list, rank: int = 3) -> Iterator[tuple[int, str]]:
        """(rank, text) of the texts of a stream, in its order."""
        cursor = 0
        for item in stream:
            found = self._place(item, cursor)
            if found is None:  # no page of the host that the wrapper knows has this
                alone = Part(item[0], parts=wrapper_of(item[1])) if item[0] else Part(None)
                inside, parts = _rated_block(alone, 0, rank) if item[0] else (rank, [])
                below = Places(parts)
            else:
                cursor = found
                _, inside, below = self.rows[found]
            if item[0] is None:
                yield inside, item[1]
            elif inside:
                yield from below.texts(item[1], inside)

    def _place(self, item: list, cursor: int) -> int | None:
        places = self.at.get(item[0], ())
        if len(places) < 2 or item[0] is None:
            later = [i for i in places if i >= cursor]
            return later[0] if later else places[0] if places else None
        keys = {part[0] for part in item[1]}
        later = sorted(places, key=lambda i: (not keys <= self.rows[i][2].at.keys(), i < cursor, i))
        return later[0]


@lru_cache(256)
def _places_of(rows: str | None) -> Places:
    return Places(json.loads(rows) if rows else [])


def main_text(page: str, places: Places) -> str:
    """Blocks of a page at the best places that it fills."""
    found = list(places.texts(Reader(page).root))
    best = min((rank for rank, _ in found if rank), default=0)
    return "\n\n".join(text for rank, text in found if rank and rank == best)


# ---- jobs -------------------------------------------------------------------------------------

WRAPPER = "host string, wrapper string"


def _row(name: str, pages: int, parts: list[Part]) -> tuple[str, str]:
    return name, json.dumps([pages, [p.listed() for p in parts]], ensure_ascii=False, separators=(",", ":"))


def _joined(known: dict, name: str, pages: int, parts: list[Part]) -> None:
    if name in known:
        known[name] = (known[name][0] + pages, align(known[name][1], parts))
    else:
        known[name] = (pages, parts)


def _of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper per host and task; a task that meets very many hosts hands them on in between."""
    known: dict[str, tuple[int, list[Part]]] = {}
    for rows in batches:
        for name, page in zip(rows["host"], rows["html"], strict=True):
            _joined(known, name, 1, wrapper_of(Reader(page).root))
        if sum(sum(p.size() for p in parts) for _, parts in known.values()) > HELD:
            yield _frame(known)
            known = {}
    yield _frame(known)


def _frame(known: dict) -> pd.DataFrame:
    return pd.DataFrame([_row(name, *known[name]) for name in known], columns=["host", "wrapper"])


def _of_wrappers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by host; one wrapper is held at a time."""
    known: dict[str, tuple[int, list[Part]]] = {}
    for rows in batches:
        for name, wrapper in zip(rows["host"], rows["wrapper"], strict=True):
            if known and name not in known:
                yield _frame(known)
                known = {}
            pages, parts = json.loads(wrapper)
            _joined(known, name, pages, [Part.read(p) for p in parts])
    yield _frame(known)


def _rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        read = [json.loads(w) for w in rows["wrapper"]]
        ready = [json.dumps(rated([Part.read(p) for p in parts], pages), separators=(",", ":")) for pages, parts in read]
        yield pd.DataFrame({"host": rows["host"], "places": ready})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of every host, as nested lists in JSON."""
    rows = pages.select(host().alias("host"), text_of("html").alias("html")).mapInPandas(_of_pages, WRAPPER)
    for keys in (["host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))], ["host"]):
        rows = rows.repartition(*keys).sortWithinPartitions("host", "wrapper").mapInPandas(_of_wrappers, WRAPPER)
    return rows


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = [main_text(p, _places_of(w)) for p, w in zip(rows["html"], rows["places"], strict=True)]
        yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    known = materialise(wrappers(pages).mapInPandas(_rates, "host string, places string"), "wrappers")
    size = known.agg(F.sum(F.length("host") + F.octet_length("places"))).first()[0] or 0
    rows = pages.select("page_id", "url", text_of("html").alias("html"), host().alias("host"))
    if size <= broadcast_bytes:
        beside = rows.join(F.broadcast(known), "host", "left")
    else:
        beside = salted_left_join(rows, known, ["host"], spread=["page_id", "url"])
    id_type = pages.schema["page_id"].dataType.simpleString()
    return beside.select("page_id", "url", "html", "places").mapInPandas(_texts, f"page_id {id_type}, url string, text string, n_chars long")
