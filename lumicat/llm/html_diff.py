"""Main text of web pages: nearest-URL page differencing within structural zones.

Every page is cut into text blocks. Pages are paired with the page of the
nearest URL path in their host; the blocks on which differencing
decides are aligned with all blocks of the partner, by their hashes, in a longest
common subsequence, and shared blocks are deleted as template text.
Differencing alone can't give whole articles: copies of an article in one host
would delete each other, articles may share passages, and menus, adverts or
footers that name the page are shared with no other. So structure has a veto on
both sides: blocks of the article are protected from deletion, blocks inside
menus, headers, footers, sidebars, notices, adverts, forms and comments go in
any case, and differencing decides on every other block. The article is, of the
outermost article elements and the main elements without those in them, the one
with most text; differencing decides on the others, teasers or a second story.

Class and id never make html, body or main a menu or the like, nor a layout
around an article. Names of comments, adverts, notices or related pages around
an article do, if another article stands outside of such names. Inside articles
only whole names count and compounds that are made of such names and of words
for their place (``comment-list``, ``post-comments``, not ``share-price``).
Compounds that speak of the article (``post-header``) or of an absence or a layout
(``no-sidebar``, ``has-sidebar``) never count. Where a page has no article or main
element, an element of a layout name that holds most of its text is no chrome.

A page has up to two partners: another query string of its path, and the
nearest other path. A partner that shares all but a few characters of the page
is a copy of it (a recrawl, a session id) and deletes nothing; the other one is
then tried. Pairing never orders a whole host in one task: paths (without
trailing slashes and page extension) are cut into ranges of their order, and
each takes the neighbour in that order which has the longer common prefix; no
other path of the host has a longer one.

Defined cases: a null or empty html gives an empty text. A page without host or
without another path or query in its host, or with copies as partners only, has
no partner and loses nothing by differencing. Repeated rows and pages of one
address are never partners of each other; each gets its own row. A tag that the
page ends in is dropped with what follows it. Extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumicat.session import checkpointed

MAIN, CHROME, OPEN = 0, 1, 2
#: A partner is a copy if less than this share of the characters that differencing decides on differs.
COPY_SHARE = 0.05
BLOCKS_TYPE = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("zones", T.ArrayType(T.IntegerType()))])

# fixed values: HTML element names by role
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "head", "title", "select", "button", "menu", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
# elements that end an open paragraph, elements that shield it, and items with the elements that shield theirs
ENDS_P = BLOCKS - {"body", "frameset", "head", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
SHIELDS = ("table", "td", "th", "caption", "button", "html")
ITEMS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
CHROME_NAME = re.compile(r"^(ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar\w*|footer\w*|header\w*|banner\w*|cookies?|consent|notices?|comments?|breadcrumbs?|share|sharing|social|related|subscribe|newsletter|popup|modal|widget\w*|toolbar)$")
#: Of these, names of layout, which may also stand around the text of a page.
LAYOUT_NAME = re.compile(r"^(nav|menu|sidebar|footer|header|banner|widget|toolbar)")
#: A compound name with one of these parts is none of chrome.
TEXT_PARTS = {"article", "post", "entry", "story", "content", "no", "not", "non", "free", "without", "with", "has"}
ABSENT = {"no", "not", "non", "free", "without", "with", "has"}
#: What a compound name of chrome may begin with, and the words for the place of chrome that may stand in it.
OWNERS = {"article", "post", "entry", "story"}
PLACES = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "container", "form", "grid", "group", "icons", "inline", "inner", "item", "items", "label", "left", "link", "links",
    "list", "message", "outer", "panel", "placeholder", "policy", "posts", "replies", "reply", "respond", "right", "row", "section", "signup", "slot", "stories", "strip", "thread", "tools", "top", "unit", "wrap", "wrapper", "zone",
}
CHROME_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}

# A quote counts only behind an equals sign; possessive, so that no page is read twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


def _chrome_compound(word: str) -> bool:
    """Whether a compound name is made of names of chrome, of which one is no layout, and of words for their place."""
    parts = [p for p in re.split(r"[-_]+", word) if p and not p.isdigit()]
    if not ABSENT.isdisjoint(parts):
        return False
    while parts and parts[0] in OWNERS:
        del parts[0]
    named = [p for p in parts if CHROME_NAME.match(p)]
    return any(not LAYOUT_NAME.match(p) for p in named) and all(p in PLACES for p in parts if p not in named)


def _chrome(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Whether an element is chrome by its tag or role, by a name (or as a form), and by a name of layout only.

    Inside articles whole names count and compounds of nothing else, elsewhere also parts of compound names.
    """
    if tag in DROPPED or tag == "header" and not in_main:
        return True, False, False
    if tag == "form":
        return False, True, True
    named, layout = False, True
    for name, *values in _ATTR.findall(attrs) if "class" in (low := attrs.lower()) or "id" in low or "role" in low else ():
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "role":
            if value in CHROME_ROLE:
                return True, False, False
        elif name in ("class", "id") and tag not in ("html", "body", "main"):
            for word in value.split():
                if _chrome_compound(word):
                    named, layout = True, False
                parts = re.split(r"[-_]+", word)
                if in_main or not TEXT_PARTS.isdisjoint(parts):
                    parts = [word]
                for part in parts:
                    if CHROME_NAME.match(part) and not (tag == "article" and LAYOUT_NAME.match(part)):
                        named, layout = True, layout and bool(LAYOUT_NAME.match(part))
    return False, named, named and layout


def blocks(page: str | None) -> tuple[list[str], list[int]]:
    """The text blocks of a page in order, and the zone of each.

    Every character and every element is handled a bounded number of times.
    """
    texts: list[str] = []
    if not page:
        return texts, []
    found: list[tuple[bool, int, int]] = []  # of each block: in chrome by tag, number of its article or main, number of the innermost chrome by name
    # open elements: name and the same three; where the elements of each name are in it
    stack: list[tuple[str, bool, int, int]] = []
    where: dict[str, list[int]] = {}
    parts: list[str] = []
    chrome = False
    main = named = 0
    articles = [False]  # of each article or main: whether it is an article
    outer, layouts = [0], [True]  # of each chrome by name: the one around it, whether its names are of layout
    holders: set[int] = set()  # chrome by name outside articles that holds an article

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                texts.append(text)
                found.append((chrome, main, named))

    def close(i: int) -> None:
        nonlocal chrome, main, named
        for x in stack[i:]:
            where[x[0]].pop()
        del stack[i:]
        chrome, main, named = stack[-1][1:] if stack else (False, 0, 0)

    def last(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            if where.get("head") and tag not in ("head", "title"):
                close(where["head"][-1])
            if tag in ENDS_P and (p := last(("p",))) > last(SHIELDS):
                close(p)
            if tag in ITEMS and (item := last(SIBLINGS.get(tag, (tag,)))) > last(ITEMS[tag]):
                close(item)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "article" and not articles[main] or tag == "main" and not main:
            k = 0 if main else named
            while k and k not in holders:
                holders.add(k)
                k = outer[k]
            main = len(articles)
            articles.append(tag == "article")
        hard, by_name, layout = _chrome(tag, m[3], main > 0)
        chrome = chrome or hard
        if by_name:
            outer.append(named)
            layouts.append(layout)
            named = len(outer) - 1
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, chrome, main, named))
    flush()

    sizes = [0] * len(outer)
    for text, (hard, _, k) in zip(texts, found):
        sizes[k] += 0 if hard else len(text)
    total = sum(sizes)
    for k in range(len(outer) - 1, 0, -1):  # outer elements have smaller numbers
        sizes[outer[k]] += sizes[k]
    firm = [False]  # whether a name that is no layout is around
    for k in range(1, len(outer)):
        firm.append(not layouts[k] or firm[outer[k]])
    free = any(unit and not hard and not firm[k] for hard, unit, k in found)
    gone = [False]
    for k in range(1, len(outer)):
        pardoned = (layouts[k] or not free) if k in holders else layouts[k] and len(articles) == 1 and 2 * sizes[k] > total
        gone.append(not pardoned or gone[outer[k]])
    lengths = [0] * len(articles)
    for text, (hard, unit, k) in zip(texts, found):
        lengths[unit] += 0 if hard or gone[k] else len(text)
    most = max(lengths[1:], default=0)
    return texts, [CHROME if hard or gone[k] else MAIN if unit and lengths[unit] == most else OPEN for hard, unit, k in found]


#: Masks of positions are kept for what stands in more places than this, and made when asked for otherwise.
FEW_PLACES = 32


def _common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each beginning of ``b``.

    A bit of the row stands for a position of ``b`` and is cleared where the
    length grows; an element of ``a`` updates all at once.
    """
    m = len(b)
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks: dict[int, int] = {}
    for x, at in places.items():
        if len(at) > FEW_PLACES:
            bits = np.zeros(m, dtype=np.uint8)
            bits[at] = 1
            masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = row = (1 << m) - 1
    for x in a:
        if (mask := masks.get(x)) is None:
            mask = 0
            for j in places.get(x, ()):
                mask |= 1 << j
        step = row & mask
        row = ((row + step) | (row - step)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((m + 7) // 8, "little"), dtype=np.uint8), count=m, bitorder="little")
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def shared_positions(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``.

    Halves of ``a`` are aligned with the two parts of ``b`` that give the most
    (Hirschberg), so memory stays linear however often a line repeats. Common
    ends and lines of one side only are cut off first.
    """
    found: set[int] = set()
    work = [(list(range(len(a))), b)]
    while work:
        at, there = work.pop()
        lo, top = 0, min(len(at), len(there))
        while lo < top and a[at[lo]] == there[lo]:
            lo += 1
        hi = 0
        while hi < top - lo and a[at[-1 - hi]] == there[-1 - hi]:
            hi += 1
        found.update(at[:lo], at[len(at) - hi :])
        at, there = at[lo : len(at) - hi], there[lo : len(there) - hi]
        left, right = {a[i] for i in at}, set(there)
        at, there = [i for i in at if a[i] in right], [x for x in there if x in left]
        if len(at) <= 1 or not there:
            found.update(at[:1] if there else ())
            continue
        if len(right & left) == 1:  # one line that repeats
            found.update(at[: min(len(at), len(there))])
            continue
        half = len(at) // 2
        ahead = _common_lengths([a[i] for i in at[:half]], there)
        behind = _common_lengths([a[i] for i in reversed(at[half:])], there[::-1])
        cut = int(np.argmax(ahead + behind[::-1]))
        work += [(at[:half], there[:cut]), (at[half:], there[cut:])]
    return found


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@F.pandas_udf(T.ArrayType(T.LongType()))
def block_hashes(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [_hash(t) for t in blocks(p)[0]])


@F.pandas_udf(BLOCKS_TYPE)
def page_blocks(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The blocks of each page that are no chrome, with their zones."""
    for batch in pages:
        found = [[(t, z) for t, z in zip(*blocks(p)) if z != CHROME] for p in batch]
        yield pd.DataFrame({"texts": [[t for t, _ in x] for x in found], "zones": [[z for _, z in x] for x in found]})


@F.pandas_udf(T.StringType())
def differenced(texts: pd.Series, zones: pd.Series, partners: pd.Series) -> pd.Series:
    """Blocks left after deleting what a page shares with the first partner that is no copy of it, outside the article."""

    def one(text, zone, others) -> str:
        loose = [t for t, z in zip(text, zone) if z == OPEN]
        hashes, size = [_hash(t) for t in loose], sum(map(len, loose))
        deleted: set[int] = set()
        for other in others if others is not None and size else ():
            shared = shared_positions(hashes, list(other))
            if sum(len(t) for i, t in enumerate(loose) if i not in shared) >= COPY_SHARE * size:
                deleted = shared
                break
        kept = iter([i not in deleted for i in range(len(loose))])
        return "\n".join(t for t, z in zip(text, zone) if z == MAIN or next(kept))

    return pd.Series([one(*x) for x in zip(texts, zones, partners)], index=texts.index, dtype=object)


def _host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _key(path: Column) -> Column:
    """A path without trailing slashes and the extension of a page."""
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"(?i)\.([xs]?html?|php[0-9]?|aspx?|jspx?|cfm|cgi|do|action)$", "")


def _address(url: Column) -> Column:
    """The key of the path and the query string."""
    return F.concat(_key(_path(url)), F.lit("?"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))


@F.pandas_udf(T.StringType())
def nearest(keys: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Of two neighbours the one with the longer common prefix, at equal length the one before."""

    def one(key, a, b):
        if a is None or b is None:
            return b if a is None else a
        return b if len(commonprefix([key, b])) > len(commonprefix([key, a])) else a

    return pd.Series([one(*x) for x in zip(keys, before, after)], index=keys.index, dtype=object)


def neighbours(keys: DataFrame) -> DataFrame:
    """_host, _key, _near: the nearest other key of the host, null where it has no other.

    Distinct keys are cut into ranges of their order; within a range the
    neighbours are the rows beside, at its ends the end rows of the ranges beside.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = checkpointed(keys.repartitionByRange(n, "_host", "_key").withColumn("_piece", F.spark_partition_id()))
    row = F.struct("_host", "_key")
    # two rows of each range
    ends = sorted(pieces.groupBy("_piece").agg(F.min(row).alias("a"), F.max(row).alias("b")).collect(), key=lambda r: r["_piece"])
    beside = [(r["_piece"], ends[i - 1]["b"] if i else None, ends[i + 1]["a"] if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    end = "struct<_host: string, _key: string>"
    joined = pieces.join(F.broadcast(keys.sparkSession.createDataFrame(beside, f"_piece int, _prev {end}, _next {end}")), "_piece")
    by = Window.partitionBy("_piece").orderBy("_host", "_key")
    same = lambda x: F.when(x["_host"] == F.col("_host"), x["_key"])
    placed = joined.select("_host", "_key", F.coalesce(F.lag(row).over(by), "_prev").alias("_prev"), F.coalesce(F.lead(row).over(by), "_next").alias("_next"))
    return placed.select("_host", "_key", nearest("_key", same(F.col("_prev")), same(F.col("_next"))).alias("_near"))


def partners(pages: DataFrame) -> DataFrame:
    """_host, _address, _partners: block hashes of another query of the path and of the nearest path, so far as there are any."""
    url = F.col("url")
    named = pages.select(_host(url).alias("_host"), _key(_path(url)).alias("_key"), _address(url).alias("_address"), F.coalesce("page_id", F.lit(-1)).alias("_id"), "html").where("_host is not null")
    hashed = named.select("_host", "_key", "_address", "_id", block_hashes(F.coalesce("html", F.lit(""))).alias("_hashes"))
    # one page stands for each address, and one address for each path; hashes stay behind until the partners are known
    reps = checkpointed(hashed.groupBy("_host", "_address").agg(F.min("_key").alias("_key"), F.min(F.struct("_id", "_hashes")).alias("_rep")).select("_host", "_key", "_address", "_rep.*"))
    names = reps.select("_host", "_key", "_address", "_id")
    of_path = names.groupBy("_host", "_key").agg(F.min(F.struct("_id", "_address"))["_address"].alias("_to"), F.count("*").alias("_n"))
    paths = neighbours(of_path.select("_host", "_key")).where("_near is not null")
    beside = paths.join(of_path.select("_host", F.col("_key").alias("_near"), "_to"), ["_host", "_near"]).select("_host", "_key", "_to")
    several = names.join(of_path.where("_n > 1").select("_host", "_key"), ["_host", "_key"], "left_semi").select("_host", F.col("_address").alias("_key"))
    queries = neighbours(several).where("_near is not null").select("_host", F.col("_key").alias("_address"), F.lit(0).alias("_rank"), F.col("_near").alias("_to"))
    links = queries.unionByName(names.join(beside, ["_host", "_key"]).select("_host", "_address", F.lit(1).alias("_rank"), "_to"))
    found = links.join(reps.select("_host", F.col("_address").alias("_to"), "_hashes"), ["_host", "_to"])
    # two at most
    return found.groupBy("_host", "_address").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_hashes"))), lambda x: x["_hashes"]).alias("_partners"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text: one row per page."""
    parsed = pages.select("page_id", "url", _host(F.col("url")).alias("_host"), _address(F.col("url")).alias("_address"), page_blocks(F.coalesce("html", F.lit(""))).alias("_blocks"))
    joined = parsed.join(partners(pages), ["_host", "_address"], "left")
    return joined.select("page_id", "url", differenced("_blocks.texts", "_blocks.zones", "_partners").alias("text"))
