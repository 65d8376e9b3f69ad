"""Main text of web pages by wrappers inferred per host.

A page is a stream of tokens: tags and texts.  From pages of a host a *wrapper* is
inferred, a regular expression without unions over such tokens: the first page is the
wrapper, and each further page is aligned with it.  Two texts that differ become a text slot; tags that
differ are resolved into a repeated group (``+``) if one side repeats the block just before, else into an
optional group (``?``).  All different pages of a host are dealt out to small groups with a wrapper each.
What stays a fixed text in the wrappers of at least half of the pages, and is then counted on at least half of
the host's different pages, is what the host prints on its pages.

The text of a page is what varies: the texts that fill slots and groups, on every page.  A filter by tags and
names follows: the ``article`` or ``main`` element on pages that have one, and nowhere
menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Each page is parsed once, for all steps: into the blocks that the filter leaves, and into its stream with
digests for texts.  Pages are different if their blocks are, so copies of a page under other addresses, menus
or adverts count as one.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import steps, stored, tasks

#: Pages of a host that one wrapper is inferred from, at least; every page goes into one wrapper.
PAGES = 6
#: Different pages of a host, about, that one task deals out to wrappers; a larger host is spread by digests.
BUCKET = 256
#: Share of a host's pages that must have a text in their wrapper, and must hold it.
HELD = 0.5
#: Two pages are one to inference if they share more than this part of all their texts: copies, near copies.
ALIKE = 0.5
#: Pages that are not alike without which nothing of a host counts as fixed.
LEAST_PAGES = 3

# Elements and names below are fixed values of the HTML standard and of common usage.
RAW = "script style textarea title iframe".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of the text, wherever they stand.
DROPPED = frozenset("head nav footer aside form dialog menu noscript template svg math object select button canvas audio video".split()) | frozenset(RAW)
MAIN = frozenset(("article", "main"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img svg math button select object audio video canvas input noscript template picture source map area embed track param".split()
)
#: What may stand unclosed, and the tags that then close it.
_BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_CLOSED_BY = {
    "head": _BLOCKS | {"body"}, "p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
CLOSES = {tag: [of for of, by in _CLOSED_BY.items() if tag in by] for tag in frozenset().union(*_CLOSED_BY.values())}
#: Where the search for an unclosed element ends.
SCOPE = {
    "head": set(), "p": {"td", "th", "li", "div", "article", "section", "blockquote"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"},
    "tr": {"table"}, "td": {"table"}, "th": {"table"},
}
#: Words in class or id, and roles, of what is not the article.
NAMES = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|widget\w*|footer|masthead|site-?header|page-?header|"
    r"cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|popup|modal|share\w*|social|comments?|comment-\w+|commentlist|disqus\w*|replies|"
    r"related|recommend\w*|pagination|pager|skip-?link|toolbar)(?:$|[_-])",
    re.IGNORECASE,
)
#: Names that tell of a neighbour, and elements whose names tell of the page.
NEIGHBOUR = ("no-", "no_", "with-", "with_", "has-", "has_")
WHOLE = frozenset(("html", "body")) | MAIN
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, value, attributes)``: kind ``<``, ``>`` (closing) or ``t``; raw elements are left out."""
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            yield "t", m["text"], ""
        elif m["open"]:
            yield "<", m["open"].lower(), m["rest"] or ""
        elif m["close"]:
            yield ">", m["close"].lower(), ""


def unwanted(tag: str, rest: str) -> bool:
    if tag in DROPPED:
        return True
    if not rest or "=" not in rest and "hidden" not in rest:
        return False
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and not value or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in WHOLE and any(NAMES.search(x) for x in value.split() if not x.startswith(NEIGHBOUR)):
            return True
    return False


# --- inference -------------------------------------------------------------------------------

SLOT = "#"


def stream(page: str, found: list | None = None) -> list:
    """A page (or its tokens ``found``) as wrapper items: ``["<", tag]``, ``[">", tag]``, ``["t", text]``, with the end tags that authors leave out."""
    out, stack = [], []

    def close(k: int) -> None:
        out.extend([">", tag] for tag in reversed(stack[k:]))
        del stack[k:]

    for kind, value, rest in tokens(page) if found is None else found:
        if kind == "t":
            if text := _clean(value):
                out.append(["t", text])
        elif kind == "<":
            for tag in CLOSES.get(value, ()):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] == tag:
                        close(k)
                        break
                    if stack[k] in SCOPE[tag]:
                        break
            out.append(["<", value])
            if value not in VOID and not rest.endswith("/"):
                stack.append(value)
        elif value in stack:
            close(len(stack) - 1 - stack[::-1].index(value))
    close(0)
    return out


def _fits(item, token) -> bool:
    """May this wrapper item stand for this token (or item of another stretch of the wrapper)?"""
    if item[0] in ("t", SLOT):
        return token[0] in ("t", SLOT)
    return item[0] == token[0] and item[1] == token[1]


def _square(wrapper: list, page: list, now: int) -> int | None:
    """The page goes on with another round of the block that the wrapper ends with: make that a group, and go on in the page."""
    at = len(wrapper)
    if at == 0 or now >= len(page) or wrapper[at - 1][0] != ">":
        return None
    closing, depth = wrapper[at - 1][1], 0
    for begin in range(at - 1, -1, -1):
        if wrapper[begin][0] in "+?":
            return None
        if wrapper[begin] == [">", closing]:
            depth += 1
        elif wrapper[begin] == ["<", closing]:
            depth -= 1
            if not depth:
                break
    else:
        return None
    if page[now] != ["<", closing]:
        return None
    block, rounds = wrapper[begin:at], 0
    while now < len(page) and (joined := _aligned(block, page, now)) is not None:
        block, now = joined
        rounds += 1
    if not rounds:
        return None
    wrapper[begin:] = [["+", block]]
    return now


def _aligned(block: list, page: list, now: int) -> tuple[list, int] | None:
    """The block widened to hold the page's next tokens too, without groups made anew."""
    out = []
    for item in block:
        if item[0] == "+":
            inner, first = item[1], True
            while (got := _aligned(inner, page, now)) is not None:
                (inner, now), first = got, False
            if first:
                return None
            out.append(["+", inner])
        elif item[0] == "?":
            got = _aligned(item[1], page, now)
            out.append(["?", got[0]] if got else item)
            now = got[1] if got else now
        elif now < len(page) and _fits(item, page[now]):
            out.append(item if item == page[now] else [SLOT])
            now += 1
        elif item[0] == SLOT:  # a slot may be empty
            out.append(item)
        else:
            return None
    return out, now


def _whole(items: list) -> bool:
    """Do the items open and close the same elements?"""
    depth = 0
    for item in items:
        if item[0] in "<>" and item[1] not in VOID:
            depth += 1 if item[0] == "<" else -1
            if depth < 0:
                return False
    return depth == 0


def _places(items: list) -> dict[tuple, list[int]]:
    """Where each tag stands."""
    found: dict[tuple, list[int]] = {}
    for at, item in enumerate(items):
        if item[0] in "<>":
            found.setdefault(tuple(item), []).append(at)
    return found


def _following(places: dict[tuple, list[int]], item: list, at: int) -> int | None:
    """The next place behind ``at`` of a tag, however far."""
    if item[0] not in "<>":
        return None
    some = places.get(tuple(item), ())
    next_ = bisect.bisect_right(some, at)
    return some[next_] if next_ < len(some) else None


def merge(wrapper: list, page: list) -> list:
    """The wrapper widened so that it stands for the page too."""
    out, at, now = [], 0, 0
    tags, own_tags = _places(wrapper), _places(page)
    while at < len(wrapper) or now < len(page):
        item = wrapper[at] if at < len(wrapper) else None
        if item is not None and item[0] in "+?":
            got = _aligned(item[1], page, now)
            at += 1
            if got is None:
                out.append(["?", item[1]] if item[0] == "?" else ["?", [item]])
                continue
            inner, now = got
            while item[0] == "+" and (got := _aligned(inner, page, now)) is not None:
                inner, now = got
            out.append([item[0], inner])
            continue
        if item is not None and now < len(page) and _fits(item, page[now]):
            out.append(item if item == page[now] else [SLOT])
            at += 1
            now += 1
            continue
        # repeated group: the page repeats the block before, or the wrapper does
        if (got := _square(out, page, now)) is not None:
            now = got
            continue
        if item is not None and (got := _square(out, wrapper, at)) is not None:
            at = got
            continue
        # optional group: skip one side up to the next place where both agree, whole elements before the shorter
        ahead = _following(tags, page[now], at) if now < len(page) else None
        behind = _following(own_tags, item, now) if item is not None else None
        if ahead is not None and behind is not None:
            first, second = _whole(wrapper[at:ahead]), _whole(page[now:behind])
            skip_wrapper = first if first != second else ahead - at <= behind - now
        else:
            skip_wrapper = ahead is not None
        if skip_wrapper:
            out.append(["?", wrapper[at:ahead]])
            at = ahead
        elif behind is not None:
            out.append(["?", page[now:behind]])
            now = behind
        else:
            if item is not None:
                out.append(["?", [item]])
                at += 1
            if now < len(page):
                out.append(["?", [page[now]]])
                now += 1
    return out


def inferred(streams: Iterable[list]) -> list:
    """Wrapper of streams of one host; of a single page it is the page, so nothing is known to be fixed."""
    wrapper = None
    for own in streams:
        wrapper = own if wrapper is None else merge(wrapper, own)
    return wrapper or []


def infer(pages: list[str]) -> list:
    """Wrapper of pages of one host."""
    return inferred(map(stream, pages))


def alike(own: set, other: set) -> bool:
    """Do two pages share more than ``ALIKE`` of their texts?"""
    return len(own & other) > ALIKE * len(own | other)


def fixed_texts(wrapper: list) -> set[str]:
    """Texts that the wrapper prints on every page, with the tag they follow."""
    out, before = set(), ""
    for item in wrapper:
        if item[0] in "<>":
            before = item[0] + item[1]
        elif item[0] == "t":
            out.add(f"{before} {item[1]}")
        elif item[0] in "+?":
            before = ""
    return out


def outline(page: str, found: list | None = None) -> tuple[str, list[int]]:
    """The stream of a page in short: its tags with a ``t`` for each text, and the texts' keys with the tag they follow."""
    before, shape, said = "", [], []
    for kind, value in stream(page, found):
        if kind == "t":
            shape.append("t")
            said.append(_key(f"{before} {value}"))
        else:
            before = kind + value
            shape.append(before)
    return " ".join(shape), said


def outlined(shape: str, said: list[int]) -> list:
    """Wrapper items of an outline, keys in place of texts."""
    keys = iter(said)
    return [["t", next(keys)] if x == "t" else [x[0], x[1:]] for x in shape.split(" ")]


def fixed_keys(wrapper: list) -> list[int]:
    """``fixed_texts`` of a wrapper of outlines."""
    out, known = set(), True
    for item in wrapper:
        if item[0] in "<>":
            known = True
        elif item[0] == "t" and known:
            out.add(item[1])
        elif item[0] in "+?":
            known = False
    return sorted(out)


# --- extraction ------------------------------------------------------------------------------


def blocks(page: str | None, found: list | None = None) -> list[tuple[str, list[str]]]:
    """What the tags and names of a page leave: each block's text, and its single texts as ``fixed_texts`` writes them."""
    if not page:
        return []
    stack: list[tuple[str, bool, bool]] = []  # tag, left out, in the article
    inside: list[tuple[bool, str, list[str]]] = []  # in the article?, block, its texts
    parts: list[str] = []
    keys: list[str] = []
    out = article = has_main = False
    before = ""

    def close_block():
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                inside.append((article, text, keys.copy()))
            parts.clear()
            keys.clear()

    for kind, value, rest in tokens(page) if found is None else found:
        if kind == "t":
            if not out:
                parts.append(html.unescape(value))
                if text := _SPACE.sub(" ", parts[-1]).strip():
                    keys.append(f"{before} {text}")
            continue
        before = kind + value
        if value not in INLINE:
            close_block()
        if kind == "<":
            for tag in CLOSES.get(value, ()):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        out, article = stack[k][1:]
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE[tag]:
                        break
            if value in VOID or rest.endswith("/") and value not in INLINE and value not in _BLOCKS:
                continue
            stack.append((value, out, article))
            if not out:
                if unwanted(value, rest) or value == "header" and not article:
                    out = True
                elif value in MAIN:
                    article = has_main = True
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == value:
                    out, article = stack[k][1:]
                    del stack[k:]
                    break
    close_block()
    return [(text, own) for kept, text, own in inside if kept or not has_main]


def main_text(page: str | None, fixed: frozenset[str] | set[str] = frozenset()) -> str:
    """Blocks of the page that are not all fixed, in page order, one to a line."""
    return "\n".join(text for text, own in blocks(page) if not all(x in fixed for x in own))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, w_host, raw, content, texts, keys, shape, said``: the blocks of each page, digests of page and blocks, its outline."""

    def rows(batches):
        for batch in steps(batches, "html"):
            found, outlines = [], []
            for page in batch.column("html").to_pylist():
                once = list(tokens(page or ""))
                found.append(blocks(page, once))
                outlines.append(outline(page, once) if found[-1] else (None, None))
            texts = [[text for text, _ in own] for own in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "url", "w_host", "raw")),
                    pa.array([_key("\n".join(own)) if own else None for own in texts], pa.int64()),
                    pa.array(texts, pa.list_(pa.string())),
                    pa.array([[[_key(x) for x in keys] for _, keys in own] for own in found], pa.list_(pa.list_(pa.int64()))),
                    pa.array([shape for shape, _ in outlines], pa.string()),
                    pa.array([said for _, said in outlines], pa.list_(pa.int64())),
                ],
                ["page_id", "url", "w_host", "raw", "content", "texts", "keys", "shape", "said"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", host(F.col("url")).alias("w_host"), F.md5("html").alias("raw"), "html").mapInArrow(
        rows,
        "page_id long, url string, w_host string, raw string, content long, texts array<string>, keys array<array<long>>, shape string, said array<long>",
    )


_OUTLINE = "w_host string, content long, raw string, shape string, said array<long>, own array<long>"


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's copies of a page those whose digest is the smallest so far: a few."""
    least: dict[tuple, str] = {}
    for batch in batches:
        taken = []
        for k, (*page, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("w_host", "content", "raw")))):
            if tuple(page) not in least or raw < least[tuple(page)]:
                least[tuple(page)] = raw
                taken.append(k)
        yield batch.take(pa.array(taken, pa.int64()))


def _votes(outlines: DataFrame, group: int) -> DataFrame:
    """``f_host, pages, fixed``: the wrappers of each bucket's pages that are not alike, ``group`` or more to a wrapper.

    Takes ``_OUTLINE, bucket, split``.  A bucket without ``LEAST_PAGES`` such pages has no wrapper; if the
    host has others (``split``) its pages are returned, without ``fixed``.
    """
    group = max(group, LEAST_PAGES)
    types = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    schema = _OUTLINE + ", pages long, fixed array<long>"
    arrow = pa.schema([(name, types[kind]) for name, kind in map(str.split, schema.split(", "))])

    def wrapper(name, some):
        fixed = fixed_keys(inferred(outlined(page["shape"], page["said"]) for page, _ in some))
        return {"w_host": name, "pages": len(some), "fixed": fixed}

    def inferences(batches):
        pages = (page for batch in batches for step in steps([batch], "shape") for page in step.to_pylist())
        for (name, _), own in itertools.groupby(pages, lambda page: (page["w_host"], page["bucket"])):
            seen, held = set(), []
            for page in own:
                if page["content"] in seen:
                    continue
                seen.add(page["content"])
                texts = set(page["own"])
                if any(alike(texts, other) for _, other in held):
                    continue
                held.append((page, texts))
                if len(held) == 2 * group:
                    yield wrapper(name, held[:group])
                    del held[:group]
            if len(held) >= LEAST_PAGES:
                yield wrapper(name, held)
            else:
                yield from ({**page, "pages": None, "fixed": None} for page, _ in held if page["split"])

    def rows(batches):
        found = inferences(batches)
        while some := list(itertools.islice(found, 256)):
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    # of the copies of a page the one with the smallest digest comes first
    return outlines.repartition(tasks(outlines), "w_host", "bucket").sortWithinPartitions("w_host", "bucket", "raw").mapInArrow(rows, schema)


def wrappers(known: DataFrame, group: int = PAGES, bucket: int = BUCKET) -> DataFrame:
    """``f_host, fixed``: keys of the texts that the wrappers of a share ``HELD`` of each host's pages have fixed.

    Every different page of a host is in one wrapper, or alike a page that is.  Hosts without ``LEAST_PAGES``
    pages that are not alike have no wrapper, and lose nothing to one.
    """
    different = known.where("content is not null")
    # few: hosts with two buckets at least
    large = stored(
        different.groupBy(F.col("w_host").alias("b_host")).agg(F.countDistinct("content").alias("n"))
        .where(F.col("n") >= 2 * bucket)
        .select("b_host", F.expr(f"n div {int(bucket)}").alias("buckets")),
        "large",
    )
    outlines = (
        different.select("w_host", "content", "raw", "shape", "said", F.flatten("keys").alias("own"))
        .mapInArrow(_first_copies, _OUTLINE)
        .join(large, F.col("w_host") == F.col("b_host"), "left")
        .withColumn("bucket", F.coalesce(F.pmod("content", "buckets"), F.lit(0).cast("long")))
        .withColumn("split", F.col("buckets").isNotNull())
        .drop("b_host", "buckets")
    )
    first = stored(_votes(outlines, group), "votes")
    rest = first.where("fixed is null").drop("pages", "fixed").withColumn("bucket", F.lit(0).cast("long")).withColumn("split", F.lit(False))
    votes = first.unionByName(_votes(rest, group)).where("fixed is not null")
    return _held(votes.select(F.col("w_host").alias("f_host"), F.col("pages").alias("weight"), F.col("fixed").alias("found")), HELD)


def _held(pages: DataFrame, held: float) -> DataFrame:
    """``f_host, fixed``: the texts found on a share ``held`` of the host's pages, from ``f_host, weight, found``.

    Pages are counted per text where they lie before anything of a host meets.
    """
    # a null stands for the page itself
    counted = (
        pages.select("f_host", "weight", F.explode(F.concat(F.array(F.lit(None).cast("long")), "found")).alias("text"))
        .groupBy("f_host", "text").agg(F.sum("weight").alias("n"))
    )
    by_host = counted.groupBy("f_host").agg(
        F.max(F.when(F.col("text").isNull(), F.col("n"))).alias("of"),
        F.collect_list(F.when(F.col("text").isNotNull(), F.struct("text", "n"))).alias("some"),
    )
    return by_host.select(
        "f_host", F.transform(F.filter("some", lambda x: x["n"] >= F.col("of") * held), lambda x: x["text"]).alias("fixed")
    ).where(F.size("fixed") > 0)


def confirmed(known: DataFrame, wrapper: DataFrame, held: float = HELD) -> DataFrame:
    """``f_host, fixed``: of the wrapper's texts those that stand on a share ``held`` of the host's different pages."""
    found = (
        known.where("content is not null").join(wrapper, F.col("w_host") == F.col("f_host"))
        .select("f_host", "content", F.array_intersect(F.flatten("keys"), "fixed").alias("found"))
        .groupBy("f_host", "content").agg(F.first("found").alias("found"))
    )
    return _held(found.withColumn("weight", F.lit(1)), held)


def extract(pages: DataFrame, group: int = PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``; ``group``: pages of one wrapper.

    Null and empty pages have empty text.  Pages without a host share one wrapper.  Rows that repeat are
    extracted one by one; an empty table gives no rows.
    """
    known = stored(parsed(pages), "blocks")
    fixed = stored(confirmed(known, stored(wrappers(known, group), "wrappers")), "fixed")
    block = F.arrays_zip("texts", "keys")
    varies = F.filter(block, lambda x: ~F.forall(x["keys"], lambda key: F.array_contains("fixed", key)))
    text = F.array_join(F.transform(F.when(F.col("fixed").isNull(), block).otherwise(varies), lambda x: x["texts"]), "\n")
    return (
        known.join(fixed, F.col("w_host") == F.col("f_host"), "left")
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
