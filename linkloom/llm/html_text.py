"""Main text of pages by template deduction over equivalence classes of tokens.

A page is a sequence of tokens: opening and closing structural tags and runs of text, each told
apart by its path of structural elements. Over the pages of a host, tokens with the same vector of
occurrence counts form an equivalence class. The vector is never built: each page adds a hash of
(page, count) to the token's sums, so that equal vectors have equal sums; tasks pre-aggregate per
host and token, and a hot host costs no task more than its distinct tokens.

A class is kept if its tokens occur in at least ``SUPPORT`` of the host's pages (``PAGES`` or more,
not all of one content). A second pass validates classes: on every page their tokens must come in
one order, repeated whole, and all inside one gap of the root class, the largest one whose tokens come once on every
page; so valid classes nest into the template. What is left are the slots.

Slots are judged by content. A frequent opening tag that comes equally often on the host's pages has a
role for each of its places there (first ``div``, second ``div``), any other one role for all. The roles
form a tree, and the second pass sums for each the text in it that is neither template nor marked as a page
part, and the share of link text. The host's main slot is found by walking down from the page: into
the child that holds ``MAJOR`` of the text, or half of it and is marked as the article (``article``, ``main``, or the role),
ending there. If no tag is marked so, generic containers beside the text of that slot that every page has and that
hold under ``MINOR`` of it (a block of advertising, say) are no part of it.

Extraction keeps the text in the main slot (if that is the marked article, in all articles of a page) but for the template's own and that in navigation, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments, which element, role, class and id
tell (a class word tells of a container inside the article only if it has no other words). Text in an
article also counts by distinct article contents: it belongs to the template only if ``PAGES`` and
``SUPPORT`` of these have it too, so copied articles stay whole. Pages of hosts too small for a template,
and pages without text in the main slot, go by marks alone: a marked article drops the text outside it
if that is no longer than its own.

Text: character references are decoded, white space inside a block is one space, blocks are joined
by an empty line in page order. Hosts come from urls, lower-cased; pages without a host form one group.

Defined cases: null and empty html give an empty text; broken markup (open or stray tags, cut-off
comments, quotes and references, any depth of nesting) is read as far as it goes, in memory linear in the
page; copies count as the pages they are; null ids and urls pass through; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.store import Tables

SUPPORT, PAGES, MAJOR, MINOR, STEADY = 0.5, 3, 0.75, 0.1, 0.1
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I | re.S)
_WORDS = re.compile(r"[^a-z0-9]+")

#: Elements of HTML by what they do to text.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "annotation", "annotation-xml", "textarea", "title", "select", "canvas", "audio", "video"}
SELF_CLOSING = {"svg", "annotation", "annotation-xml"}
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()) - {"br"}
NESTED = set("html head body div section article main nav aside header footer form ul ol dl table tr td th blockquote figure dialog menu search fieldset details address h1 h2 h3 h4 h5 h6 button".split())
DROPPED = {"head", "nav", "aside", "footer", "form", "menu", "search", "dialog", "button"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
DROPPED_WORDS = set(
    "ad ads adsense advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored promo promos promotion banner nav navbar navigation navi menu menus sidebar sidebars footer masthead breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies discussion disqus related recommended share sharing social toolbar pagination pager".split()
)
WHOLE = {"html", "body", "main", "article"}
CONTAINERS = {"div", "section", "table", "tr", "td", "th", "fieldset", "details"}


def host_of(url: str | None) -> str:
    """A url's host without user and port, lower-cased."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _judge(name: str, attrs: str, in_article: bool) -> tuple[str, bool, bool]:
    """(name with classes, whether it is dropped, whether it is the article) of an element."""
    role = marks = ""
    hidden = False
    if attrs:
        for key, *values in _NAMES.findall(attrs):
            value, key = next(filter(None, values), "").lower(), key.lower()
            if key == "role":
                role = value.strip()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif key in ("class", "id"):
                marks += " " + value
    words = set(_WORDS.split(marks)) if marks else ()
    told = words - {""} if words else set()
    # inside an article a name such as related-work or status-notice says little; all of its words must be telling
    by_mark = bool(told) and (told <= DROPPED_WORDS and name[:1] != "h" if in_article else not DROPPED_WORDS.isdisjoint(told))
    if name in ("html", "body"):
        return name, False, False
    article = name in ("article", "main") or role in ("article", "main")
    if name == "article" and in_article:
        article = False
    out = hidden or name in DROPPED or role in DROPPED_ROLES or name == "header" and not in_article or marks.split() == ["header"]
    if by_mark and (name not in WHOLE or not words.isdisjoint({"comment", "comments", "reply", "advert", "ad", "sponsored", "promo", "related"})):
        out = True
    return name + ("." + ".".join(sorted(words - {""})) if words else ""), out, article and not out


Part = tuple[int, str, int, bool, bool, int]


def events(page: str) -> Iterator[Part]:
    """(kind, text or name, path, dropped, in the article, open elements) of a page's parts; paths are hashes of the open elements' names.

    Kinds: 0 text, 1 a structural tag opens, 2 one closes, 3 another block boundary, 4 a line break, 5 a link opens or ('/') closes.
    """
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    at, size, open_names = 0, len(page), Counter()
    while at < size:
        m = _MARKUP.search(page, at)
        begin = m.start() if m else size
        _, path, dropped, inside = stack[-1]
        if begin > at:
            yield 0, page[at:begin], path, dropped, inside, len(stack) - 1
        if not m:
            return
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name in NESTED and open_names[name]:
                while True:
                    own = stack.pop()
                    open_names[own[0]] -= 1
                    if own[0] == name:
                        break
                yield 2, name, own[1], own[2], own[3], len(stack) - 1
            elif name in BLOCK:
                yield 3, name, path, dropped, inside, len(stack) - 1
            elif name == "a":
                yield 5, "/", path, dropped, inside, len(stack) - 1
        elif name in RAW:
            if name not in SELF_CLOSING or not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
        elif name in NESTED:
            marked, out, article = _judge(name, attrs, inside)
            if _heading(stack[-1][0]) and _heading(name):
                open_names[stack.pop()[0]] -= 1  # a heading ends an open one
                _, path, dropped, inside = stack[-1]
            stack.append((name, _hash(f"{path}/{marked}"), dropped or out, inside or article))
            open_names[name] += 1
            yield 1, name, stack[-1][1], stack[-1][2], stack[-1][3], len(stack) - 1
        elif name == "br":
            yield 4, name, path, dropped, inside, len(stack) - 1
        elif name in BLOCK:
            yield 3, name, path, dropped, inside, len(stack) - 1
        elif name == "a":
            yield 5, "", path, dropped, inside, len(stack) - 1


def _heading(name: str) -> bool:
    return name[:1] == "h" and name[1:].isdigit()


def _hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def token_of(kind: int, text: str, path: int) -> int:
    """A token's hash: its kind, its path, and for text the text."""
    return _hash(f"{kind}{path}\0{' '.join(text.split()) if kind == 0 else text}")


def tokens(page: str) -> list[int]:
    """The tokens of a page that can belong to a template, in order."""
    return _tokens(events(page))


def _tokens(parts: Iterable[Part]) -> list[int]:
    return [token_of(k, text, path) for k, text, path, *_ in parts if k in (1, 2) or k == 0 and not text.isspace()]


def _roles(parts: list[Part], steady: dict[int, bool]) -> Iterator[list[tuple[int, int]]]:
    """For each part the (role, kind) of the open elements; steady has the frequent opening tags, true for those with a role for each place.

    Kinds are sums of 1 (opens the article) and 2 (a generic container). Rare elements have the role of what they are in.
    """
    stack: list[tuple[int, int]] = []
    seen: Counter = Counter()
    was_inside = [False]
    for kind, name, path, _, inside, depth in parts:
        del stack[depth - (kind == 1) :], was_inside[depth + (kind != 1) :]
        if kind == 1:
            token = token_of(1, name, path)
            own, above = steady.get(token), stack[-1] if stack else (0, 0)
            if own is None:
                stack.append((above[0], 0))
            else:
                place = seen[token] if own else 0
                stack.append((_hash(f"{above[0]}>{token}:{place}"), (inside and not was_inside[-1]) + 2 * (name in CONTAINERS)))
            seen[token] += 1
            was_inside.append(inside)
        yield stack


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of some pages: pages, occurrences, sums of vector hashes, least and greatest page."""
    names = ["host", "token", "pages", "times", "low", "high", "first", "last", "squares"]
    for batch in batches:
        held: dict[tuple[str, int], list[int]] = {}
        for url, page in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            host, own = host_of(url), _hash(page or "")
            for token, n in [(0, 1), *Counter(tokens(page or "")).items()]:
                mixed = xxhash.xxh64_intdigest(own.to_bytes(8, "little", signed=True), n)
                row = held.get((host, token))
                if row is None:
                    held[host, token] = [1, n, mixed & 0xFFFFFFFF, mixed >> 32, own, own, n * n]
                else:
                    row[0] += 1
                    row[1] += n
                    row[2] += mixed & 0xFFFFFFFF
                    row[3] += mixed >> 32
                    row[4], row[5] = min(row[4], own), max(row[5], own)
                    row[6] += n * n
        cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [()] * 9
        yield pa.record_batch([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(cols)], names)


def classes(pages: DataFrame) -> DataFrame:
    """(host, root, members): of each host the root class's id and an array of (token, class, steady) of its frequent classes.

    A token is steady if it comes about equally often on nearly all pages (variance and missing share up to STEADY).

    A host's frequent tokens number at most 1 / SUPPORT times the tokens of its mean page.
    """
    sums = pages.select("url", "html").mapInArrow(_counts, "host string, token long, pages long, times long, low long, high long, first long, last long, squares long")
    stats = sums.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "times", "low", "high", "squares")), F.min("first").alias("first"), F.max("last").alias("last"))
    tables = Tables(pages.sparkSession)
    often = tables.write(stats.where((F.col("pages") >= PAGES) & ((F.col("first") != F.col("last")) | (F.col("token") == 0))), "tokens")
    totals = often.where("token = 0").select("host", F.col("pages").alias("all"))
    frequent = often.where("token <> 0").join(totals, "host").where(F.col("pages") >= SUPPORT * F.col("all")).withColumn("class", F.xxhash64("pages", "times", "low", "high"))
    whole = F.when((F.col("pages") == F.col("all")) & (F.col("times") == F.col("all")), F.col("class"))
    mean = F.col("times") / F.col("all")
    steady = (F.col("squares") / F.col("all") - mean * mean <= STEADY) & (F.col("pages") >= (1 - STEADY) * F.col("all"))
    return frequent.groupBy("host").agg(F.mode(whole, True).alias("root"), F.collect_list(F.struct("token", "class", steady.alias("steady"))).alias("members"))


def _gaps(own_tokens: list[int], root: int | None, of: dict[int, int]) -> tuple[dict[int, list[int]], dict[int, set[int]]]:
    """By class: its tokens in page order, and the gaps of the root class they lie in."""
    order, gaps, gap = defaultdict(list), defaultdict(set), 0
    for token in own_tokens:
        own = of.get(token)
        if own is None:
            continue
        order[own].append(token)
        if own == root:
            gap += 1
        else:
            gaps[own].add(gap)
    return order, gaps


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and class of some pages: hash of its order and its gap, least and greatest; 0 pages out of order count as such.

    Rows with broken = -1 are (host, 0, token, article, ...): the frequent texts in each article content, and token 0 for
    the article itself. Rows with broken = -2 are (host, role, role above, kind, text, link text, -2, pages), role 0 the page.
    """
    names = ["host", "class", "order_low", "order_high", "gap_low", "gap_high", "broken", "pages"]
    for batch in batches:
        held: dict[tuple[str, int], list[int]] = {}
        slots: dict[tuple[str, int], list[int]] = {}
        known: dict[str, tuple[dict[int, int], dict[int, bool]]] = {}
        seen: set[tuple[str, int, int]] = set()
        for page, host, root, members in zip(*(batch.column(k) for k in range(4)), strict=True):
            host, root = host.as_py(), root.as_py()
            if host not in known:
                rows = members.as_py()
                known[host] = {m["token"]: m["class"] for m in rows}, {m["token"]: m["steady"] for m in rows}
            of, steady = known[host]
            parts = list(events(page.as_py() or ""))
            order, gaps = _gaps(_tokens(parts), root, of)
            texts = [(text, path) for k, text, path, dropped, inside, _ in parts if k == 0 and inside and not dropped and not text.isspace()]
            if texts:
                article = _hash("\0".join(" ".join(text.split()) for text, _ in texts))
                seen.update((host, t, article) for t in (0, *(t for t in (token_of(0, *x) for x in texts) if t in of)))
            for own, seq in order.items():
                once = list(dict.fromkeys(seq))
                broken = int(seq != once * (len(seq) // len(once)) or len(gaps[own]) > 1)
                sign, gap = _hash(" ".join(map(str, once))), min(gaps[own], default=0)
                row = held.get((host, own))
                if row is None:
                    held[host, own] = [sign, sign, gap, gap, broken]
                else:
                    held[host, own] = [min(row[0], sign), max(row[1], sign), min(row[2], gap), max(row[3], gap), row[4] + broken]
            for role, (above, kind, text, link) in _mass(parts, steady, of).items():
                row = slots.setdefault((host, role), [above, kind, 0, 0, 0])
                row[1] |= kind
                row[2] += text
                row[3] += link
                row[4] += 1
        out = [(*k, *v, 0) for k, v in held.items()] + [(h, 0, t, article, 0, 0, -1, 0) for h, t, article in seen]
        out += [(*k, *v[:4], -2, v[4]) for k, v in slots.items()]
        cols = list(zip(*out, strict=True)) or [()] * 8
        yield pa.record_batch([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(cols)], names)


def _mass(parts: list[Part], steady: dict[int, bool], frequent: dict[int, int]) -> dict[int, list[int]]:
    """Of a page's roles: [role above, kind, characters of text, characters of link text]; frequent texts and marked page parts don't count."""
    out, linked = {0: [0, 0, 0, 0]}, False
    for (kind, text, path, dropped, _, _), stack in zip(parts, _roles(parts, steady), strict=True):
        if kind == 1:
            above = stack[-2][0] if len(stack) > 1 else 0
            if stack[-1][0] != above:
                out.setdefault(stack[-1][0], [above, stack[-1][1], 0, 0])
        elif kind == 5:
            linked = text == ""
        elif kind == 0 and not dropped and not text.isspace() and token_of(0, text, path) not in frequent:
            for role in {0, *(r for r, _ in stack)}:
                out[role][2 + linked] += len(text.strip())
    return out


def main_slot(rows: list[dict]) -> tuple[int | None, bool, list[int]]:
    """(main slot, whether it is marked as the article, roles beside its text) of a host, from its roles (role, above, kind, text, link, pages)."""
    of = {r["role"]: r for r in rows}
    kids, marked = defaultdict(list), set()
    for r in rows:
        if r["role"]:
            kids[r["above"]].append(r)
        if r["kind"] & 1:
            at = r["role"]
            while at and at not in marked:
                marked.add(at)
                at = of[at]["above"] if at in of else 0
    if not of.get(0, {}).get("text"):
        return None, False, []
    at, all_pages = 0, of[0]["pages"]
    while not of[at]["kind"] & 1:
        fit = [k for k in kids[at] if k["text"] >= (0.5 if k["role"] in marked else MAJOR) * of[at]["text"]]
        if not fit:
            break
        at = max(fit, key=lambda k: (k["text"], -k["role"]))["role"]
    if at in marked:
        return at, bool(of[at]["kind"] & 1), []
    beside = [k["role"] for k in kids[at] if k["kind"] & 2 and k["role"] not in marked and k["pages"] >= (1 - STEADY) * all_pages and (k["text"] < MINOR * of[at]["text"] or k["link"] > k["text"])]
    return at, False, beside


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_slot(x) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.list_(pa.int64()))))], ["host", "slot", "marked", "beside"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, marks, slot, marked, beside), as a written table: the frequent tokens (token, template, steady), the main slot, whether it is marked as the article, and roles beside its text."""
    tables = Tables(pages.sparkSession)
    found = tables.write(classes(pages), "classes")
    hosted = pages.select(host_column("url").alias("host"), "html").join(found, "host")
    sums = hosted.select("html", "host", "root", "members").mapInArrow(_evidence, "host string, class long, order_low long, order_high long, gap_low long, gap_high long, broken long, pages long")
    sums = tables.write(sums, "evidence")
    articles = tables.write(sums.where("broken = -1").groupBy("host", F.col("order_low").alias("token")).agg(F.count_distinct("order_high").alias("n")), "article-texts")
    totals = articles.where("token = 0").select("host", F.col("n").alias("all"))
    least = F.greatest(F.lit(PAGES), SUPPORT * F.col("all"))
    of_articles = lambda fit, name: F.collect_list(F.when(fit, F.col("token"))).alias(name)
    copied = articles.where("token <> 0").join(totals, "host").groupBy("host").agg(of_articles(F.col("n") < least, "copied"), of_articles(F.col("n") < F.greatest(F.lit(PAGES), MAJOR * F.col("all")), "uncommon"))
    judged = sums.where("broken >= 0").groupBy("host", "class").agg(F.min("order_low").alias("a"), F.max("order_high").alias("b"), F.min("gap_low").alias("c"), F.max("gap_high").alias("d"), F.sum("broken").alias("broken"))
    valid = judged.where("a = b and c = d and broken = 0").groupBy("host").agg(F.collect_set("class").alias("valid"))
    roles = sums.where("broken = -2").groupBy("host", F.col("class").alias("role")).agg(F.min("order_low").alias("above"), F.bit_or("order_high").alias("kind"), F.sum("gap_low").alias("text"), F.sum("gap_high").alias("link"), F.sum("pages").alias("pages"))
    # of a host there are as many roles as frequent opening tags on a page, at most 1 / SUPPORT times those of its mean page
    slots = roles.groupBy("host").agg(F.collect_list(F.struct("role", "above", "kind", "text", "link", "pages")).alias("roles")).mapInArrow(_slots, "host string, slot long, marked boolean, beside array<long>")
    none = F.array().cast("array<bigint>")
    fixed = lambda m: F.array_contains(F.coalesce("valid", none), m["class"]) & ~F.array_contains(F.coalesce("copied", none), m["token"])
    common = lambda m: ~F.array_contains(F.coalesce("uncommon", none), m["token"])
    marks = F.transform("members", lambda m: F.struct(m["token"].alias("token"), fixed(m).alias("template"), m["steady"].alias("steady"), (fixed(m) & common(m)).alias("common")))
    return tables.write(found.join(valid, "host", "left").join(copied, "host", "left").join(slots, "host", "left").select("host", marks.alias("marks"), "slot", "marked", "beside"), "templates")


def host_column(url: str) -> F.Column:
    """``host_of`` as a column expression."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


@dataclass(frozen=True)
class Template:
    """What is known of a host: its template's tokens, those that most of its articles have, its frequent opening tags, its main slot and roles beside its text."""

    tokens: frozenset[int] = frozenset()
    common: frozenset[int] = frozenset()
    steady: dict[int, bool] = field(default_factory=dict)
    slot: int | None = None
    marked: bool = False
    beside: frozenset[int] = frozenset()


def _article_texts(parts: list[Part], held: list[bool], template: Template) -> list[bool]:
    """Which texts of the article (held) go out: all but page parts.

    A text of the template stands in an article like any other, as headings and phrases that a host repeats do. It is a page part
    in a block, or an element, that has nothing but such texts and is mostly links; and before the first or after
    the last block of the article's own, if most articles have it there, but for a heading of what follows.
    """
    elements: list[list] = []  # parent, characters, linked characters, whether any is the article's own
    blocks: list[list] = []  # texts, element, characters, linked characters, own, whether all are common, heading
    stack: list[tuple[int, str]] = []
    run: list | None = None
    linked = False
    for i, (kind, text, path, dropped, _, depth) in enumerate(parts):
        del stack[max(0, depth - (kind == 1)) :]
        if kind in (1, 2, 3):
            run = None
        if kind == 1:
            elements.append([stack[-1][0] if stack else -1, 0, 0, False])
            stack.append((len(elements) - 1, text))
        elif kind == 5:
            linked = text == ""
        elif kind == 0 and held[i] and not dropped and not text.isspace():
            token, n = token_of(0, text, path), len(text.strip())
            own = token not in template.tokens
            if run is None:
                run = [[], stack[-1][0] if stack else -1, 0, 0, False, True, any(_heading(name) for _, name in stack[-1:])]
                blocks.append(run)
            run[0].append(i)
            run[2] += n
            run[3] += n * linked
            run[4] |= own
            run[5] &= token in template.common
    for _, at, n, link, own, *_ in blocks:
        if at >= 0:
            e = elements[at]
            e[1], e[2], e[3] = e[1] + n, e[2] + link, e[3] or own
    for parent, n, link, own in reversed(elements):
        if parent >= 0:
            e = elements[parent]
            e[1], e[2], e[3] = e[1] + n, e[2] + link, e[3] or own
    gone: list[bool] = []
    for parent, n, link, own in elements:
        gone.append(parent >= 0 and gone[parent] or bool(n) and not own and 2 * link > n)
    owns = [k for k, x in enumerate(blocks) if x[4]]
    out = [False] * len(parts)
    for k, (texts, at, n, link, own, common, heading) in enumerate(blocks):
        links = not own and 2 * link > n or at >= 0 and gone[at]
        outside = owns and not own and common and not owns[0] < k < owns[-1] and not (heading and k + 1 < len(blocks) and blocks[k + 1][4])
        for i in texts:
            out[i] = not (links or outside)
    return out


def main_text(page: str, template: Template = Template()) -> str:
    """The main text of a page, given its host's template."""
    parts = list(events(page))
    if template.slot is not None:
        slot, beside = template.slot, template.beside
        # where the slot is the marked article, so is what other articles of a page hold
        held = lambda part, stack: template.marked and part[4] or (not slot or any(r == slot for r, _ in stack)) and not any(r in beside for r, _ in stack)
        inside = [part[0] == 0 and held(part, stack) for part, stack in zip(parts, _roles(parts, template.steady), strict=True)]
        if slot:
            good = _article_texts(parts, inside, template)
        else:  # the slot is the whole page, where the template is what is around the article
            good = [own and not part[3] and token_of(0, part[1], part[2]) not in template.tokens for own, part in zip(inside, parts, strict=True)]
        if any(own and token_of(0, part[1], part[2]) not in template.tokens for own, part in zip(good, parts, strict=True) if own and not part[1].isspace()):
            return _joined(parts, _spaces(parts, inside, good))
    good = [k == 0 and not dropped and not (template.tokens and token_of(0, text, path) in template.tokens) for k, text, path, dropped, *_ in parts]
    sizes = [0, 0]
    for own, (_, text, _, _, inside_it, _) in zip(good, parts, strict=True):
        sizes[inside_it] += own and len(text.strip())
    if sizes[1] >= sizes[0] and any(inside_it and k == 1 for k, _, _, _, inside_it, _ in parts):
        inside = [part[0] == 0 and part[4] for part in parts]
        good = _spaces(parts, inside, _article_texts(parts, inside, template))
    return _joined(parts, good)


def _spaces(parts: list[Part], held: list[bool], good: list[bool]) -> list[bool]:
    """good, with the white space between texts."""
    return [own or inside and not part[3] and part[1].isspace() for own, inside, part in zip(good, held, parts, strict=True)]


def _joined(parts: list[Part], good: list[bool]) -> str:
    """The texts that are good, as blocks."""
    blocks, run = [], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    for own, (kind, text, *_) in zip(good, parts, strict=True):
        if kind == 4:
            run.append(" ")
        elif kind in (1, 2, 3):
            flush()
        elif own:
            run.append(entities.unescape(text) if "&" in text else text)
    flush()
    return "\n\n".join(blocks)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        out = []
        for page, host, marks, slot, marked, beside in zip(*(batch.column(k) for k in range(2, 8)), strict=True):
            name = host.as_py()
            if name not in known:
                if len(known) >= 1000:
                    known.clear()
                rows = marks.as_py() or ()
                known[name] = Template(frozenset(m["token"] for m in rows if m["template"]), frozenset(m["token"] for m in rows if m["common"]), {m["token"]: m["steady"] for m in rows}, slot.as_py(), bool(marked.as_py()), frozenset(beside.as_py() or ()))
            out.append(main_text(page.as_py() or "", known[name]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hosted = pages.withColumn("host", host_column("url")).join(templates(pages), "host", "left")
    return hosted.select("page_id", "url", "html", "host", "marks", "slot", "marked", "beside").mapInArrow(_texts, "page_id long, url string, text string")
