"""HTML extraction (4): wrappers by union-free regular-expression inference.

A page is a stream of block tags and texts. The streams of one host's pages are aligned one after the other: neighbouring
repeats become a repeated group, what only one side has becomes optional, equal texts stay literal and differing ones
become slots. Literal texts that both sides have are aligned first, so a template's parts hold their places among
siblings of the same name. What is left is the host's wrapper, a regular expression without unions, and for every page
structure the place of each of its texts in it: the alignment itself says so, nothing is matched afterwards.

Places of the wrapper are judged once for the host, from what its different pages put there: how often a text repeats, how much
of the pages' text stands there, and the elements around. A page's main text is what it has in the places that stay.

Equal structures of a host are counted before they are aligned, in rounds of salted groups, so no task sees the pages
or all structures of a large host; all statistics are plain aggregates.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, ids_of, spread_join, stored

# Elements by their role in HTML, and words of class names and ids that mark what is no main text.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title".split())
BLOCKS = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split())
VOID = frozenset(["hr"])
BOILER_TAGS = frozenset("head nav footer aside form menu dialog fieldset search".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay sidebar rail widget nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar header comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search form pagination pager skip".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article content main post entry story".split())
# Words before a boilerplate word of the same class that make it say how a page is laid out or filed.
MODIFIERS = frozenset("has have with without no not is category cat tag type format layout".split())
# An opening tag that ends an open element of the same row.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

DEPTH = 100  # elements nested deeper become children of the one at this depth, as browsers do at theirs

# No repeat here gives anything back, so a match or a failure takes one pass.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_OPENS = re.compile(r"<(?:!--|([!?])|/?([a-zA-Z]))")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_LONG_NUMBER = re.compile(r"&#[0-9]{9,}+;?")


def marks_boilerplate(token: list[str]) -> bool:
    """Whether a class, as its words, names what is no main text. "entry-header" does not, as headlines stand there."""
    at = [k for k, w in enumerate(token) if w in BOILER_WORDS]
    if not at or MODIFIERS & set(token[: at[0]]):
        return False
    return not ({token[k] for k in at} == {"header"} and MAIN_WORDS & set(token))


def key_of(tag: str, attrs: str) -> tuple[str, int, bool]:
    """An element's name in wrappers (its tag, a mark and its first class or id), how far it is the main one (2: an element for
    that, 1: by its words), and whether it holds no main text."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)} if attrs and not attrs.isspace() else {}
    tokens = [[w for w in _PARTS.split(t) if w] for t in f"{found.get('class', '')} {found.get('id', '')}".split()]
    against = [t for t in tokens if marks_boilerplate(t)]
    speaks = any(MAIN_WORDS & set(t) for t in tokens if t not in against)
    roles = set(found.get("role", "").split())
    element = tag in MAIN_TAGS or bool(roles & {"main", "article"}) or "articlebody" in found.get("itemprop", "")
    boiler = tag in BOILER_TAGS or bool(roles & BOILER_ROLES) or "hidden" in found or found.get("aria-hidden") == "true"
    if element:  # words inside a longer class say nothing against it, <article class="comment"> does
        against = [] if tag == "main" or "main" in roles else [t for t in against if len(t) == 1]
    boiler = boiler or bool(against) and not speaks and tag not in ("html", "body")
    main = 0 if boiler else 2 if element else 1 if speaks and tag in ("div", "section") else 0
    name = (found.get("class") or found.get("id") or "").split()
    return tag + ("!" if boiler else ("", "=", "+")[main]) + ("." + re.sub(r"\d+", "", name[0]) if name else ""), main, boiler


class Item:
    """A part of a wrapper: a text ("#"), a group ("") or an element, optional or repeated or both.

    Texts have a literal (a hash, None once different texts met there) and leaves: numbers of the texts they stand for."""

    __slots__ = ("key", "name", "optional", "repeated", "items", "literal", "leaves")

    def __init__(self, key: str, items: list[Item] | None = None, leaves: list[int] | None = None):
        self.key, self.items, self.leaves = key, items if items is not None else [], leaves
        self.name = key or "(" + " ".join(x.name for x in self.items) + ")"
        self.optional = self.repeated = False
        self.literal: int | None = None


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def decoded(text: str) -> str:
    return " ".join(html.unescape(_LONG_NUMBER.sub("�", text)).split())


def tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" of a closing tag, tag, attributes) for all tags in order, and last the text after them with an empty tag.

    Comments, declarations and elements of RAW are left out. One pass: should the quotes of a tag never close, quotes do not
    count from there on; a tag without an end takes the rest of the page."""
    at = begun = 0
    parts: list[str] = []
    pattern = _TAG
    while (lt := page.find("<", at)) >= 0:
        m = pattern.match(page, lt)
        if m is None:
            opens = _OPENS.match(page, lt)
            if opens is None:  # a sign in a text
                at = lt + 1
                continue
            if opens[2] and pattern is _TAG:
                pattern, at = _PLAIN_TAG, lt
                continue
            parts.append(page[begun:lt])
            end = -1 if opens[2] else page.find(">", lt) + 1 if opens[1] else page.find("-->", lt + 4) + 3
            begun = at = len(page) if end < 3 else end
            continue
        parts.append(page[begun:lt])
        at = begun = m.end()
        tag = m[2].lower()
        if tag not in RAW:
            yield "".join(parts), m[1], tag, m[3]
            parts = []
        elif not m[1] and not (m[3].endswith("/") and tag in ("svg", "math")):
            end = _ENDS[tag].search(page, at)
            close = page.find(">", end.end()) + 1 if end else 0
            at = begun = close or len(page)
    yield "".join(parts) + page[begun:], "", "", ""


def blocks(page: str) -> tuple[list[tuple[int, str, int, int, bool]], Item]:
    """(number of the "#", text, characters inside links, main, boiler) of every block in page order, and the page's tree.
    Open elements at the end of the page are closed there."""
    out: list[tuple[int, str, int, int, bool]] = []
    root = Item("/")
    stack: list[tuple[str, Item, int, bool]] = [("/", root, 0, False)]
    still_open: Counter[str] = Counter()
    words: list[str] = []
    links = link = leaves = 0

    def shut(k: int) -> None:
        for tag, *_ in stack[k:]:
            still_open[tag] -= 1
        del stack[k:]

    for text, close, tag, attrs in tags(page):
        if text:
            words.append(text)
            if link:
                links += len(text.strip())
        if tag and tag not in BLOCKS:
            if tag == "a":
                link = 0 if close else 1
            elif tag == "br":
                words.append(" ")
            continue
        if words and (text := decoded("".join(words))):
            items = stack[-1][1].items
            if not items or items[-1].key != "#":
                items.append(Item("#", leaves=[leaves]))
                leaves += 1
            out.append((items[-1].leaves[0], text, links, *stack[-1][2:]))
        words, links, link = [], 0, 0
        if close:
            if still_open[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                shut(k)
            continue
        if tag != "p" and tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    shut(k)
                    break
                if stack[k][0] not in ("p", "td", "th"):
                    break
        elif stack[-1][0] == "p":
            shut(len(stack) - 1)
        if tag in VOID or not tag:
            continue
        key, main, boiler = key_of(tag, attrs)
        item = Item(key)
        stack[min(len(stack), DEPTH) - 1][1].items.append(item)
        still_open[tag] += 1
        stack.append((tag, item, max(main, stack[-1][2]), boiler or stack[-1][3]))
    return out, root


# -- alignment -------------------------------------------------------------------------------------

MOST_CELLS = 1 << 29  # bits of one table of lcs; longer lists are aligned half by half


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence. A row of the table is one integer with a bit for each element of b."""
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = [(k, k) for k in range(lo)]
    x, y = a[lo:n], b[lo:m]
    if len(x) * len(y) > MOST_CELLS:
        i, j = len(x) // 2, len(y) // 2
        out += [(p + lo, q + lo) for p, q in lcs(x[:i], y[:j])] + [(p + lo + i, q + lo + j) for p, q in lcs(x[i:], y[j:])]
    elif x and y:
        where: dict = {}
        for k, t in enumerate(y):
            where[t] = where.get(t, 0) | 1 << k
        full = (1 << len(y)) - 1
        v, rows = full, []
        for t in x:
            u = v & where.get(t, 0)
            v = (v + u | v - u) & full
            rows.append(v)
        i, j, found = len(x) - 1, len(y) - 1, []
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:
                j -= 1
            elif i and not rows[i - 1] >> j & 1:
                i -= 1
            else:
                found.append((i + lo, j + lo))
                i, j = i - 1, j - 1
        out += found[::-1]
    return out + [(n + k, m + k) for k in range(len(a) - n)]


def literal_of(x: Item):
    """What an item says where all of it is literal, else None."""
    if x.key == "#":
        return x.literal
    inner = [literal_of(y) for y in x.items]
    return hash((x.name, *inner)) if inner and None not in inner else None


def common(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """Positions of items of both that are the same: first those alike in names and texts, between them by names."""
    firm = lcs([(x.name, s) if (s := literal_of(x)) is not None else k for k, x in enumerate(a)], [(x.name, s) if (s := literal_of(x)) is not None else -1 - k for k, x in enumerate(b)])
    out, i, j = [], 0, 0
    for p, q in [*firm, (len(a), len(b))]:
        out += [(i + x, j + y) for x, y in lcs([x.name for x in a[i:p]], [x.name for x in b[j:q]])]
        if p < len(a):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def merge(a: Item, b: Item) -> None:
    """b, of the same name, becomes part of a."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    if a.key == "#":
        a.leaves += b.leaves
        if a.literal != b.literal:
            a.literal = None
    else:
        a.items = align(a.items, b.items)


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """One list of items for two: what one side lacks is optional."""
    if [x.name for x in a] == [x.name for x in b]:
        for x, y in zip(a, b, strict=True):
            merge(x, y)
        return a
    out, i, j = [], 0, 0
    for p, q in [*common(a, b), (len(a), len(b))]:
        for x in (*a[i:p], *b[j:q]):
            x.optional = True
            out.append(x)
        if p < len(a):
            merge(a[p], b[q])
            out.append(a[p])
        i, j = p + 1, q + 1
    return fold(out)


def fold(items: list[Item]) -> list[Item]:
    """Neighbouring repeats of one to three items become one repeated item or group."""
    for size in (1, 2, 3):
        out: list[Item] = []
        for x in items:
            out.append(x)
            if size == 1:
                if len(out) > 1 and out[-2].name == x.name:
                    out.pop()
                    merge(out[-1], x)
                    out[-1].repeated = True
                continue
            tail = [y.name for y in out[-size:]]
            if len(out) > size and out[-size - 1].key == "" and [y.name for y in out[-size - 1].items] == tail:
                group = out[-size - 1]
            elif len(out) >= 2 * size and [y.name for y in out[-2 * size : -size]] == tail:
                group = Item("", out[-2 * size : -size])
                out[-2 * size : -size] = [group]
            else:
                continue
            for y, z in zip(group.items, out[-size:], strict=True):
                merge(y, z)
            del out[-size:]
            group.repeated = True
        items = out
    return items


def shaped(x: Item) -> Item:
    """A page's tree as a wrapper of its own."""
    x.items = fold([shaped(y) for y in x.items])
    return x


def texts_in(x: Item) -> Iterator[Item]:
    """The texts of a wrapper in order: a slot's number is its place here."""
    if x.key == "#":
        yield x
    for y in x.items:
        yield from texts_in(y)


def as_list(x: Item) -> list:
    return [x.key, 2 * x.optional + x.repeated, x.literal if x.key == "#" else [as_list(y) for y in x.items]]


def from_list(v: list) -> Item:
    x = Item(v[0], None if v[0] == "#" else [from_list(y) for y in v[2]])
    x.optional, x.repeated = bool(v[1] & 2), bool(v[1] & 1)
    if v[0] == "#":
        x.literal = v[2]
    return x


def as_expression(x: Item) -> str:
    """The wrapper written as a regular expression over tags and #text (=text where it is literal)."""
    inner = "".join(" " + as_expression(y) for y in x.items)
    flags = ("", "+", "?", "*")[2 * x.optional + x.repeated]
    return (("#text" if x.literal is None else "=text") if x.key == "#" else f"({inner[1:]})" if not x.key else f"<{x.key}>{inner} </>") + flags


def joined(wrappers: list[Item]) -> tuple[Item, list[list[int]]]:
    """One wrapper for all, and for each the places of its slots in it."""
    offset = 0
    for w in wrappers:
        for x in texts_in(w):
            x.leaves = [offset]
            offset += 1
    sizes = [sum(1 for _ in texts_in(w)) for w in wrappers]
    whole = wrappers[0]
    for w in wrappers[1:]:
        merge(whole, w)
    place = [0] * offset
    for k, x in enumerate(texts_in(whole)):
        for leaf in x.leaves:
            place[leaf] = k
    out, at = [], 0
    for n in sizes:
        out.append(place[at : at + n])
        at += n
    return whole, out


# -- jobs ------------------------------------------------------------------------------------------

STRUCTURES = 64  # distinct structures of a host that are aligned in one group
EDGE = 3  # texts at either end of a repeated slot that are also judged by themselves
LINKS = 0.8  # share of characters in links above which a slot of a page is no main text
# Evidence for a place of the wrapper; it stays if the sum is above 0. A text that does not change between k pages counts log2 k
# against it: no element and no share of the pages' text outweighs that on every host.
IN_MAIN, IN_NAMED, IN_BOILER, ELSE, SHARE = 2.5, 1.5, -4.0, 0.5, 5.0


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def read(page: str) -> tuple:
    """structure (JSON), key, whole (hash of structure and texts), total, blocks [(slot, edges, linky, text)] and
    stats [(slot, edge, hash, chars, main, boiler)] of a page; edge 0 is the whole slot, edges are bits."""
    found, root = blocks(page)
    shaped(root)
    slots = list(texts_in(root))
    structure = json.dumps(as_list(root))
    of: dict[int, tuple[int, list[int]]] = {}
    for k, x in enumerate(slots):
        n = len(x.leaves)
        for i, leaf in enumerate(x.leaves):
            of[leaf] = k, [e for e in (i + 1 if i < EDGE else 0, EDGE + n - i if n - i <= EDGE else 0) if e] if n > 1 else []
    texts: dict[tuple[int, int], list[str]] = {}
    seen: dict[int, list[int]] = {}
    for leaf, text, links, main, boiler in found:
        k, edges = of[leaf]
        for e in (0, *edges):
            texts.setdefault((k, e), []).append(text)
        s = seen.setdefault(k, [0, 0, 0, 0])
        seen[k] = [s[0] + len(text), s[1] + links, max(s[2], main), max(s[3], boiler)]
    out = [(of[leaf][0], sum(1 << e for e in of[leaf][1]), seen[of[leaf][0]][1] > LINKS * seen[of[leaf][0]][0], text) for leaf, text, *_ in found]
    stats = [(k, e, hashed("\n".join(t)), sum(map(len, t)), seen[k][2], bool(seen[k][3])) for (k, e), t in texts.items()]
    key = hashed(structure)
    whole = hashed("\n".join([str(key), *(f"{b[0]} {b[3]}" for b in out)]))
    return structure, key, whole, sum(len(t) for _, t, _, _, boiler in found if not boiler), out, stats


PARSED = (
    "page_id long, url string, host string, structure string, key long, whole long, total long, "
    "blocks array<struct<slot: int, edges: int, linky: boolean, text: string>>, stats array<struct<slot: int, edge: int, hash: long, chars: long, main: int, boiler: boolean>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 500):
                part = f.iloc[lo : lo + 500]
                rows = [(host_of(u), *read(h or "")) for u, h in zip(part["url"], part["html"], strict=True)]
                out = pd.DataFrame(rows, columns=["host", "structure", "key", "whole", "total", "blocks", "stats"])
                out.insert(0, "url", part["url"].to_numpy())
                out.insert(0, "page_id", ids_of(part["page_id"]))
                yield out

    return pages.select(id_text("page_id"), "url", "html").mapInPandas(run, PARSED)


def salted(left: DataFrame) -> DataFrame:
    """left(host, id, ...) with groups (of the host) and salt: about STRUCTURES wrappers of a host in each."""
    n = left.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / STRUCTURES).alias("groups"))
    return spread_join(left, n, ["host"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("groups")))


def together(f: pd.DataFrame) -> pd.DataFrame:
    """One group of wrappers aligned: a row for each with its places in the new wrapper, and the new wrapper once."""
    f = f.sort_values("id")
    wrappers = []
    for text, literals in zip(f["wrapper"], f["literals"], strict=True):
        w = from_list(json.loads(text))
        if literals is not None:
            for x, s in zip(texts_in(w), literals, strict=True):
                x.literal = None if s is None or s != s else int(s)
        wrappers.append(w)
    whole, places = joined(wrappers)
    text = json.dumps(as_list(whole))
    return pd.DataFrame({"host": f["host"], "id": f["id"], "to": hashed(text), "places": places, "wrapper": [text, *[None] * (len(f) - 1)]})


def infer(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper) of every host; (host, key, places): where the slots of each structure stand in it."""
    literal = (
        found.select("host", "key", F.explode("stats").alias("s")).filter("s.edge = 0").groupBy("host", "key", "s.slot").agg(F.min("s.hash").alias("a"), F.max("s.hash").alias("z"))
        .groupBy("host", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.when(F.col("a") == F.col("z"), F.col("a").cast("string")).alias("literal")))), lambda x: x["literal"]).alias("literals"))
    )
    kinds = found.select("host", "key", "structure").dropDuplicates(["host", "key"]).join(literal, ["host", "key"], "left")
    kinds = kinds.select("host", "key", "structure", F.coalesce("literals", F.array().cast("array<string>")).alias("literals"))
    kinds = stored(kinds, "wrappers-structures")
    left = kinds.select("host", F.col("key").alias("id"), F.col("structure").alias("wrapper"), "literals")
    at = kinds.select("host", "key", F.col("key").alias("id"), F.expr("transform(literals, (x, i) -> i)").alias("places"))
    while True:
        groups = stored(salted(left), "wrappers-groups")
        last = (groups.agg(F.max("groups")).first()[0] or 0) <= 1
        new = stored(groups.groupBy("host", "salt").applyInPandas(together, "host string, id long, to long, places array<int>, wrapper string"), "wrappers-aligned")
        moved = new.select("host", "id", "to", F.col("places").alias("then"))
        at = at.join(moved, ["host", "id"]).select("host", "key", F.col("to").alias("id"), F.transform("places", lambda i: F.element_at("then", i + 1)).alias("places"))
        at = stored(at, "wrappers-places", groups)
        left = stored(new.filter("wrapper is not null").select("host", F.col("to").alias("id"), "wrapper").dropDuplicates(["host", "id"]).withColumn("literals", F.lit(None).cast("array<string>")), "wrappers-left")
        if last:
            return left.select("host", "wrapper"), at.drop("id")


def evidence(main: Column, boiler: Column, share: Column, pages: Column, most: Column, texts: Column) -> Column:
    """The weight for keeping a place. Of `pages` different pages `most` have the most frequent of the place's `texts` different texts.

    Where texts differ, that text and its pages do not count, so the copies of one article, different elsewhere, do not make
    a place of articles look like a template."""
    again = F.when(texts == 1, most).otherwise((1 + pages - most) / texts)
    role = F.when(boiler, IN_BOILER).when(main == 2, IN_MAIN).when(main == 1, IN_NAMED).otherwise(ELSE)
    return role + SHARE * share - F.log2(again.cast("double"))


def judge(found: DataFrame, at: DataFrame) -> DataFrame:
    """host, key, main, edges, level: for each slot of a structure -1 if it goes, else how far it is in a main element, and bits of
    the ends that go; and how far in main elements most of the host's text stands. Equal pages count once."""
    different = stored(found.select("host", "key", "whole", "total", "stats").dropDuplicates(["host", "whole"]), "wrappers-different")
    each = spread_join(different, at, ["host", "key"]).select("host", "places", "total", F.explode("stats").alias("s"))
    each = each.select("host", F.element_at("places", F.col("s.slot") + 1).alias("place"), "total", "s.*")
    texts = each.groupBy("host", "place", "edge", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("total").alias("total"), F.max("main").alias("main"), F.max("boiler").alias("boiler"))
    stats = texts.groupBy("host", "place", "edge").agg(F.sum("n").alias("pages"), F.max("n").alias("most"), F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars"), F.sum("total").alias("total"), F.max("main").alias("main"), F.max("boiler").alias("boiler"))
    share = F.least(F.col("chars") / F.greatest("total", F.lit(1)), F.lit(1.0))
    scored = stats.withColumn("keep", evidence(F.col("main"), F.col("boiler"), share, F.col("pages"), F.col("most"), F.col("texts")) > 0)
    places = scored.groupBy("host", "place").agg(
        F.max(F.when(F.col("edge") == 0, F.when(F.col("keep"), F.col("main")).otherwise(-1))).alias("main"),
        F.sum(F.when((F.col("edge") > 0) & ~F.col("keep"), F.expr("shiftleft(1, edge)")).otherwise(0)).cast("int").alias("edges"),
        F.sum(F.when((F.col("edge") == 0) & F.col("keep"), F.col("chars")).otherwise(0)).alias("chars"),
    )
    held = lambda least: F.sum(F.when(F.col("main") >= least, F.col("chars")).otherwise(0))
    hosts = places.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("place", "main", "edges"))).alias("told"),
        F.when(2 * held(2) > held(0), 2).when(2 * held(1) > held(0), 1).otherwise(0).alias("level"),
    )
    of = lambda c: F.transform("places", lambda i: F.element_at("told", i + 1)[c]).alias(c)
    return spread_join(at, hosts, ["host"]).select("host", "key", of("main"), of("edges"), "level")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row for every row of pages; other columns are ignored.

    Blocks in places of the host's wrapper that stay, in page order, joined by newlines, without slots outside main elements
    that are almost all links on the page. If most of the host's kept text stands in article (or main) elements, these alone count
    where a page has them; else, if most stands in elements named so, these.

    What does not change goes by how many pages of its host show it: a notice inside an article that three pages repeat stays, one that forty
    repeat goes, so the same page can be read differently on a larger host.

    Null html counts as empty, null urls share one host; a page without main text has the empty text. Equal pages of a host get equal
    texts and count once in its statistics; repeated rows are extracted each by itself; an empty table gives no rows. Pages of any
    length and nesting take time in proportion to their length, but for alignment: lists of siblings meet in tables of
    bits, half by half above MOST_CELLS. Unclosed tags, comments and quotes reach to the end of the page."""
    found = stored(parsed(pages), "wrappers-pages")
    _, at = infer(found)
    judged = stored(judge(found, at), "wrappers-judged")
    told = spread_join(found.select("page_id", "url", "host", "key", "blocks"), judged, ["host", "key"])
    slot = lambda c, b: F.element_at(c, b["slot"] + 1)
    stay = F.filter("blocks", lambda b: (slot("main", b) >= 0) & (slot("edges", b).bitwiseAND(b["edges"]) == 0) & ((slot("main", b) > 0) | ~b["linky"]))
    inner = F.filter("stay", lambda b: slot("main", b) >= F.col("level"))
    told = told.withColumn("stay", stay).withColumn("inner", inner)
    text = F.array_join(F.transform(F.when(F.size("inner") > 0, F.col("inner")).otherwise(F.col("stay")), lambda b: b["text"]), "\n")
    return told.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
