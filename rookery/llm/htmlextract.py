"""HTML extraction by equivalence-class template deduction.

A page's tokens are its tags, told apart by their path of tags, classes and ids, and its text blocks, told apart by their path
and text, inside articles as well. Tokens of a host's pages that have the same occurrence vector (how often on which page) form an
equivalence class. A class is valid if

* it stands on more than `share` (half) of the host's pages, so that an article copied to some pages of a host is no class,
* it has `least_tokens` tokens, one of them a tag,
* its tokens come in the same order on every page, over and over where it occurs more than once,
* it nests: of two classes, every occurrence of one lies in one gap between the other's tokens; of two that do not, the one on
  fewer pages (then the smaller, then the one of the larger hash) is invalid.

Text of a valid class is template text and goes, inside an article or a main element too. What lies between the tokens of a valid
class are its slots; a text belongs to the slot that the nearest valid token before it opens. A slot holds no main text if over
half of its characters on all of the host's pages are aside (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, by tag or by a fixed list of words) or in blocks made mostly of links; else its blocks are judged one by one by the same
signs. On a page with an article or a main element only what is inside it is main text.

No host's pages are brought together: an occurrence vector is represented by its number of pages and two sums over pages of
a hash of page and count, which add up map-side. A second pass adds up each class's least and greatest hash of order, the
pairs of classes that do not nest and the characters of slots. A template has a bounded size (a token must be on `share` of the
host's pages, so at most tokens-per-page / share can be), and goes to the pages by a join on the host, broadcast while all
templates together are below `broadcast_tokens`.

Defined results: null or empty html gives the empty text; a null url, or one without a host, belongs to the empty host; a host
with fewer than `least_pages` pages has no template, and the page is one slot; repeated rows count as pages of their own and each get
a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .urlfilter import host_of

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACES = re.compile(r"\s+")
#: Fixed lists of the HTML language.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noframes noembed xmp template svg math object canvas".split())
#: What an open tag closes when one of its kind, or for p any block, begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Tags, and words of class, id and role, that mark what is not main text.
ASIDE_TAGS = set("head nav aside footer form button select dialog datalist fieldset".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager topbar toolbar header masthead footer contentinfo "
    "sidebar aside complementary widget widgets related recommended share sharing social "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall "
    "comment comments commentlist respond replies disqus login signup search".split()
)


def _label(name: str, rest: str) -> tuple[str, bool]:
    """The tag with its classes, id and role, and whether that marks something aside."""
    words: list[str] = []
    if "=" in rest:
        for m in _ATTRIBUTE.finditer(rest):
            words += [w for w in re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower()) if w]
    aside = name in ASIDE_TAGS or (name not in ("html", "body", "main", "article") and not ASIDE_WORDS.isdisjoint(words))
    if name == "article" and not {"comment", "comments"}.isdisjoint(words):
        aside = True
    return ".".join([name, *sorted(w for w in set(words) if not any(c.isdigit() for c in w))]), aside


def blocks(html: str) -> Iterator[tuple[str, str, bool, bool, bool, float, str]]:
    """(kind, token, ...) of a page in order.

    ("tag", path, ...) for each tag that is not inline; ("text", text, aside, inside an article, inside main, share of its
    characters in links, path) for each block of text, white space turned into one space, trimmed, not empty.
    """
    stack: list[tuple[str, str, bool]] = []
    text: list[str] = []
    links, linked, skip, at = 0, 0, None, 0

    def flush():
        nonlocal linked
        whole = _SPACES.sub(" ", unescape("".join(text))).strip() if text else ""
        part, linked = linked, 0
        text.clear()
        if whole:
            names = [s[0] for s in stack]
            aside = any(s[2] for s in stack) or ("header" in names and "article" not in names[: names.index("header")])
            yield "text", whole, aside, "article" in names, "main" in names, min(1.0, part / len(whole)), stack[-1][1] if stack else ""

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if skip is None and m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            linked += len(piece.strip()) if links else 0
        at = m.end()
        name = m["name"]
        if name is None:
            if m[0].startswith("<![CDATA[") and skip is None:
                text.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        name, closing, rest = name.lower(), bool(m["end"]), m["rest"]
        if name in RAW:
            if not closing and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else 1
            elif name == "br":
                text.append(" ")
            continue
        yield from flush()
        links = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        shuts, scope = CLOSES.get(name, ()), SCOPES.get(name, ())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in shuts or (stack[i][0] == "p" and name not in shuts):
                del stack[i:]
                break
            if stack[i][0] in scope or stack[i][0] in ("td", "th", "body", "article", "button", "div"):
                break
        label, aside = _label(name, rest)
        path = f"{stack[-1][1]}/{label}" if stack else label
        yield "tag", path, aside, False, False, 0.0, path
        if name not in VOID and not rest.endswith("/"):
            stack.append((name, path, aside))
    if at < len(html) and skip is None:
        text.append(html[at:])
    yield from flush()


def token_hash(kind: str, value: str, path: str = "") -> int:
    """Texts have even hashes, tags odd ones."""
    if kind == "tag":
        return xxhash.xxh64_intdigest(value, 1) >> 1 | 1
    return xxhash.xxh64_intdigest(f"{path}\0{value}", 2) >> 2 << 1


def page_tokens(html: str | None) -> dict[int, int]:
    """How often each token stands on the page."""
    out: dict[int, int] = {}
    for kind, value, _, _, _, _, path in blocks(html or ""):
        h = token_hash(kind, value, path)
        out[h] = out.get(h, 0) + 1
    return out


def _not_nested(a: list[int], m: int, b: list[int], n: int) -> bool:
    """Whether neither class, given by its places and number of tokens, has all its occurrences in gaps of the other."""
    within = lambda x, k, y: all(bisect_left(y, x[i]) == bisect_left(y, x[i + k - 1]) for i in range(0, len(x), k))
    return not (within(a, m, b) or within(b, n, a))


def page_classes(html: str | None, class_of: dict[int, int], sizes: dict[int, int]) -> tuple[dict[int, int], set[tuple[int, int]], dict[tuple[int, int], list[int]]]:
    """Of the classes on a page: a hash of the order of each (-1: it has none), pairs that do not nest, and by (class, slot) the
    characters of the texts that are in no class, and those of them that are no main text."""
    places: dict[int, list[int]] = {c: [] for c in sizes}
    order: dict[int, list[int]] = {c: [] for c in sizes}
    slots: dict[tuple[int, int], list[int]] = {}
    for at, (kind, value, aside, article, main, link, path) in enumerate(blocks(html or "")):
        h = token_hash(kind, value, path)
        c = class_of.get(h)
        if c is not None:
            places[c].append(at)
            order[c].append(h)
        elif kind == "text":
            off = aside or (link > 0.5 and not (article or main))
            for c, seen in places.items():
                s = slots.setdefault((c, (len(seen) - 1) % sizes[c] if seen else -1), [0, 0])
                s[0] += len(value)
                s[1] += len(value) * off
    signs = {}
    for c, seen in order.items():
        once = seen[: sizes[c]]
        if seen:
            ordered = len(set(once)) == sizes[c] and seen == once * (len(seen) // sizes[c])
            signs[c] = xxhash.xxh64_intdigest(np.array(once, np.int64).tobytes()) >> 1 if ordered else -1
    good = [c for c, sign in signs.items() if sign >= 0]
    crossed = {(min(a, b), max(a, b)) for i, a in enumerate(good) for b in good[:i] if _not_nested(places[a], sizes[a], places[b], sizes[b])}
    return signs, crossed, slots


def main_text(html: str | None, template: dict[int, int] | set[int], sizes: dict[int, int] | None = None, shut: set[tuple[int, int]] | frozenset = frozenset()) -> str:
    """Main text of a page: the blocks in the slots that hold it, in page order, joined by newlines.

    The template gives the class of each token of valid classes, sizes the classes' numbers of tokens, shut the (class, slot)
    that hold no main text."""
    found, seen, last = [], dict.fromkeys(sizes or (), 0), None
    for kind, value, aside, article, main, link, path in blocks(html or ""):
        h = token_hash(kind, value, path)
        if h in template:
            if sizes:
                last = template[h]
                seen[last] += 1
        elif kind == "text":
            off = last is not None and (last, (seen[last] - 1) % sizes[last]) in shut
            found.append((value, aside or off, article, main, link))
        if kind == "text" and h in template:
            found.append((value, True, article, main, link))
    if any(article for _, _, article, _, _ in found):
        kept = [v for v, aside, article, _, _ in found if article and not aside]
    elif any(main for _, _, _, main, _ in found):
        kept = [v for v, aside, _, main, _ in found if main and not aside]
    else:
        kept = [v for v, aside, _, _, link in found if not aside and link <= 0.5]
    return "\n".join(kept)


def token_statistics(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, token, s1, s2, on_pages): the occurrence vector of every token of every host; token -1 counts the host's pages."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"), F.monotonically_increasing_id().alias("page"))

    def work(batches):
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, html, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = page_tokens(html)
                own[-1] = 1
                for token, n in own.items():
                    mix = xxhash.xxh64_intdigest(f"{page} {n}")
                    s = sums.setdefault((host, token), [0, 0, 0])
                    s[0] += mix & 0x7FFFFFFF
                    s[1] += mix >> 33
                    s[2] += 1
            keys, values = list(sums), np.array(list(sums.values()), np.int64).reshape(-1, 3)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array(np.ascontiguousarray(v)) for v in values.T)]
            yield pa.RecordBatch.from_arrays(columns, ["host", "token", "s1", "s2", "on_pages"])

    counted = rows.mapInArrow(work, "host string, token bigint, s1 bigint, s2 bigint, on_pages bigint")
    return counted.groupBy("host", "token").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("on_pages").alias("on_pages"))


def candidates(pages: DataFrame, url: str, html: str, least_pages: int, share: float, least_tokens: int) -> DataFrame:
    """(host, classes): (on_pages, id, tokens) of each host's classes that stand on enough pages and have enough tokens, with a tag."""
    known = stored(token_statistics(pages, url, html).where(F.col("on_pages") >= least_pages), "tokens")
    hosts = known.where("token = -1").select("host", F.col("on_pages").alias("pages"))
    frequent = known.where("token <> -1").join(hosts, "host").where(F.col("on_pages") > share * F.col("pages"))
    classes = frequent.groupBy("host", "s1", "s2", "on_pages").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    classes = classes.where((F.size("tokens") >= least_tokens) & F.exists("tokens", lambda t: t % 2 == 1))
    return classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("on_pages", F.col("tokens")[0].alias("id"), "tokens"))).alias("classes"))


def _joined(pages: DataFrame, by_host: DataFrame, url: str, columns: list, broadcast: bool) -> DataFrame:
    rows = pages.select(*columns, host_of(F.col(url)).alias("rookery_host"))
    by_host = by_host.withColumnRenamed("host", "rookery_host")
    return rows.join(F.broadcast(by_host) if broadcast else by_host, "rookery_host", "left")


def templates(
    pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = 3, share: float = 0.5, least_tokens: int = 2, broadcast_tokens: int = 500_000
) -> DataFrame:
    """(host, classes, shut): the tokens of each host's valid equivalence classes, and the (class, slot) that hold no main text; a
    class is known by its least token."""
    found = stored(candidates(pages, url, html, least_pages, share, least_tokens), "classes")
    size = found.agg(F.sum(F.expr("aggregate(classes, 10, (n, c) -> n + size(c.tokens))"))).first()[0] or 0
    bounded_batches(pages.sparkSession)
    rows = _joined(pages, found, url, [F.col(html).alias("rookery_html")], size <= broadcast_tokens).where("classes is not null").select("rookery_host", "rookery_html", "classes")

    def work(batches):
        known: dict[str, tuple] = {}
        for b in batches:
            out: dict[tuple, list[int]] = {}
            for host, page, classes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    listed = classes.as_py()
                    known[host] = {t: c["id"] for c in listed for t in c["tokens"]}, {c["id"]: len(c["tokens"]) for c in listed}
                signs, crossed, slots = page_classes(page, *known[host])
                for c, sign in signs.items():
                    low = out.setdefault((host, "order", c, 0), [sign, sign])
                    low[:] = min(low[0], sign), max(low[1], sign)
                for a, z in crossed:
                    out[host, "crossed", a, z] = [0, 0]
                for (c, slot), (n, off) in slots.items():
                    s = out.setdefault((host, "slot", c, slot), [0, 0])
                    s[0] += n
                    s[1] += off
            keys, values = list(out), list(out.values())
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
            columns += [pa.array([k[i] for k in keys], pa.int64()) for i in (2, 3)] + [pa.array([v[i] for v in values], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["rookery_host", "what", "a", "b", "x", "y"])

    told = rows.mapInArrow(work, "rookery_host string, what string, a bigint, b bigint, x bigint, y bigint")
    sums = [F.sum(F.when(F.col("what") == "slot", F.col(c))).alias(f"sum_{c}") for c in "xy"]
    told = told.groupBy("rookery_host", "what", "a", "b").agg(F.min("x").alias("min_x"), F.max("y").alias("max_y"), *sums)
    ordered = (F.col("what") == "order") & (F.col("min_x") >= 0) & (F.col("min_x") == F.col("max_y"))
    shut = (F.col("what") == "slot") & (2 * F.col("sum_y") > F.col("sum_x"))
    told = told.groupBy(F.col("rookery_host").alias("host")).agg(
        F.collect_list(F.when(ordered, F.col("a"))).alias("ordered"),
        F.collect_list(F.when(F.col("what") == "crossed", F.struct("a", "b"))).alias("crossed"),
        F.collect_list(F.when(shut, F.struct("a", "b"))).alias("shut"),
    )
    whole = found.join(told, "host").select("host", "classes", "ordered", "crossed", "shut")
    schema = "host string, classes array<struct<id: bigint, tokens: array<bigint>>>, shut array<struct<a: bigint, b: bigint>>"

    def valid(batches):
        for b in batches:
            hosts, kept_of, shut_of = b.column(0).to_pylist(), [], []
            for classes, ordered, crossed, shut in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                bad = {frozenset((p["a"], p["b"])) for p in crossed}
                kept: list[dict] = []
                for c in sorted(classes, key=lambda c: (-c["on_pages"], -len(c["tokens"]), c["id"])):
                    if c["id"] in ordered and not any(frozenset((c["id"], k["id"])) in bad for k in kept):
                        kept.append({"id": c["id"], "tokens": c["tokens"]})
                ids = {k["id"] for k in kept}
                kept_of.append(kept)
                shut_of.append([p for p in shut if p["a"] in ids])
            types = [pa.list_(pa.struct([("id", pa.int64()), ("tokens", pa.list_(pa.int64()))])), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kept_of, types[0]), pa.array(shut_of, types[1])], ["host", "classes", "shut"])

    return whole.mapInArrow(valid, schema)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_tokens: int = 500_000, **more) -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    found = stored(templates(pages, url, html, broadcast_tokens=broadcast_tokens, **more), "templates")
    size = found.agg(F.sum(F.expr("aggregate(classes, 10 + size(shut), (n, c) -> n + size(c.tokens))"))).first()[0] or 0
    bounded_batches(pages.sparkSession)
    rows = _joined(pages, found, url, [F.col(key), F.col(url), F.col(html)], size <= broadcast_tokens).select(key, url, html, "rookery_host", "classes", "shut")

    def work(batches):
        known: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for page, host, classes, shut in zip(b.column(2), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    listed = classes.as_py() or []
                    pairs = {(p["a"], p["b"]) for p in shut.as_py() or ()}
                    known[host] = {t: c["id"] for c in listed for t in c["tokens"]}, {c["id"]: len(c["tokens"]) for c in listed}, pairs
                texts.append(main_text(page.as_py(), *known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return rows.mapInArrow(work, f"`{key}` {dict(rows.dtypes)[key]}, {url} string, text string, n_chars bigint")
