"""HTML main text by template deduction.

A page is read as tokens: its elements, and the words of its texts, each told apart by the path of block elements above it and by its place: of a container, among
siblings of one name; of a word, among its repeats in a block. Over the pages of a host, tokens with the same occurrence vector (how often each page has them) form an equivalence class (Arasu and
Garcia-Molina, 2003). A class is valid where its elements nest: the element above one is in a valid class too. Valid classes that occur once a page are the template; words in
the class of the element around them are template texts. What remains between are the slots, and the main text is the slot that holds nearly all that varies on the host's
pages, found from the page inwards. Nothing inside it is taken for template text, so it is given whole.

Lists of element names and words leave out menus, headers, footers and the like, which vary from page to page as texts do; they decide alone for a page whose host has no other page, or
which lacks its host's slot.

Vectors are never built: a token's vector is stood for by its number of pages and sums of two hashes over (page, count), which tasks pre-aggregate,
so a host with a third of all pages costs one row a token and task. Pages are known by a hash of their html, so copies of a page tell nothing more than the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import scratch
from parcelflow.llm.urls import host_of

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
SPACES = re.compile(r"\s+")

#: Fixed lists of HTML element names.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "svg", "object", "canvas", "video", "audio", "map", *RAW}
#: Elements that an opening of the key ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
CLOSE_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words of class, id and role that name what isn't main text.
NOT_MAIN = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "comment", "comments", "disqus", "reply", "replies", "respond", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "popup", "modal", "toolbar", "pagination", "pager", "search", "widget", "complementary", "contentinfo"}
MAIN = {"article", "main"}
#: Containers: only these can be slots, and are told apart by their places.
HOLDS = {"html", "body", "div", "section", "table", "tbody", "tr", "td", "center", "details", *MAIN}
#: The columns that stand for an occurrence vector.
VECTOR = ("n_pages", "total", "v1", "v2")
#: Kinds of tokens, and the token of the page.
ELEMENT, HOLDER, MAIN_HOLDER, WORD, PAGE = 0, 1, 2, 3, 0
#: An element in a path: name, words of class, id and role, place among siblings that are the same in these.
Step = tuple[str, tuple[str, ...], int]


def events(page: str) -> Iterator[tuple]:
    """("text", path, words), ("open", path) and ("break",) in page order. A path is a tuple of block elements; inline elements only carry text."""
    stack: list[Step] = []
    names: list[str] = []
    seen: list[dict] = [defaultdict(int)]
    at, n = 0, len(page)
    lower = None

    def pop(k: int) -> None:
        del stack[k:], names[k:], seen[k + 1 :]

    while at < n:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            yield "text", tuple(stack), entities.unescape(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE:
                continue
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                yield ("break",)
                pop(k)
            elif name in ("br", "p"):
                yield ("break",)
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == n else -1
            if end < 0 and (found := re.compile(f"</{name}", re.I).search(page, at)):
                end = found.start()
            close = page.find(">", end) if end >= 0 else -1
            at = n if close < 0 else close + 1
            yield "open", (*stack, (name, (), 0))
            continue
        if name in INLINE:
            continue
        yield ("break",)
        if name in VOID:
            continue
        if name in CLOSE_P and "p" in names:
            k = len(names) - 1 - names[::-1].index("p")
            if not {"td", "th", "li", "blockquote"} & set(names[k:]):
                pop(k)
        for other in ENDS.get(name, ()):
            if other in names:
                k = len(names) - 1 - names[::-1].index(other)
                if not {"ul", "ol", "table", "dl"} & set(names[k:]):
                    pop(k)
        words = [w for g in NAMED.findall(m[3]) for x in g if x for w in x.lower().split()]
        if HIDDEN.search(m[3]):
            words.append("hidden")
        here = (name, tuple(words))
        names.append(name)
        stack.append((*here, seen[-1][here] if name in HOLDS else 0))
        seen[-1][here] += 1
        seen.append(defaultdict(int))
        if m[3].endswith("/") and name in ("div", "section", "article"):
            continue
        yield "open", tuple(stack)


def outside(step: Step) -> bool:
    """Whether an element is no main text by its name, class, id or role."""
    name, words, _ = step
    if name in OUTSIDE:
        return True
    if name in ("body", "html") or not words:
        return False
    return "hidden" in words or any(part in NOT_MAIN for w in words for part in re.split(r"[-_]+", w))


def blocks(page: str | None) -> Iterator[tuple[tuple[Step, ...], str | None]]:
    """(path, text) of each block with text, white space as one space, and (path, None) where an element opens, in page order."""
    parts: list[str] = []
    where: tuple[Step, ...] = ()

    def ended():
        text = SPACES.sub(" ", "".join(parts)).strip()
        parts.clear()
        return [(where, text)] if text else []

    for kind, *rest in events(page or ""):
        if kind == "text":
            if parts and rest[0] != where:
                yield from ended()
            where = rest[0]
            parts.append(rest[1])
        elif kind == "break" or rest[0][-1][0] in RAW:
            yield from ended()
        if kind == "open":
            yield rest[0], None
    yield from ended()


class Tokens:
    """Numbers of paths and words, remembered within a page."""

    def __init__(self):
        self.known: dict[tuple[Step, ...], int] = {(): PAGE}

    def path(self, path: tuple[Step, ...]) -> int:
        if (t := self.known.get(path)) is None:
            t = self.known[path] = xxhash.xxh64_intdigest(repr((self.path(path[:-1]), path[-1]))) >> 1
        return t

    @staticmethod
    def word(parent: int, word: str, nth: int) -> int:
        return xxhash.xxh64_intdigest(f"{parent} {nth} {word}", seed=1) >> 1


def tokens(page: str | None, lists: bool = True) -> dict:
    """token -> [parent, kind, how often the page has it, characters]: of a word its own, of an element those of all texts below it that no name calls boilerplate (lists: whether names are asked at all).
    A word is a tuple of the element around it, the word, and which of its repeats in the block it is; given are those that the page has as often as the element, since no others can be in its class."""
    found: dict = {PAGE: [-1, HOLDER, 1, 0]}
    if not page:
        return {}
    number = Tokens()
    for path, text in blocks(page):
        mine = number.path(path)
        if text is None:
            name = path[-1][0]
            kind = MAIN_HOLDER if name in MAIN else HOLDER if name in HOLDS else ELEMENT
            found.setdefault(mine, [number.path(path[:-1]), kind, 0, 0])[2] += 1
            continue
        if lists and any(map(outside, path)):
            continue
        words = text.split(" ")
        size = len(text) - len(words) + 1
        for w, n in Counter(words).items():
            for nth in range(n):
                if one := found.get((mine, w, nth)):
                    one[2] += 1
                    one[3] += len(w)
                else:
                    found[mine, w, nth] = [mine, WORD, 1, len(w)]
        for k in range(len(path) + 1):
            if (t := number.path(path[:k])) in found:
                found[t][3] += size
    return {t: v for t, v in found.items() if v[1] != WORD or v[0] in found and v[2] == found[v[0]][2]}


def token_vectors(pages: DataFrame, lists: bool = True) -> DataFrame:
    """pages (host, html) -> (host, token, parent, kind, n_pages, total, v1, v2, chars): v1 and v2 stand for the token's occurrence vector. Null and empty pages have no tokens; copies of a page count with
    it, as often in every token, so that tokens with one vector keep one vector.

    A word is template text only if its vector is that of the element around it. Where the word occurs so does the element, so a word that differs from it
    within a batch differs at last: what such a batch has of it is left out, and never makes it equal."""

    def run(batches):
        for b in batches:
            by_host: dict[str, dict] = defaultdict(dict)
            for host, page in ((h.as_py(), p.as_py()) for h, p in zip(b.column("host"), b.column("html"))):
                digest, sums = xxhash.xxh64_intdigest(page or ""), by_host[host]
                hashes: dict[int, int] = {}
                for token, (parent, kind, n, chars) in tokens(page, lists).items():
                    if (h := hashes.get(n)) is None:
                        h = hashes[n] = xxhash.xxh64_intdigest(f"{digest} {n}")
                    if s := sums.get(token):
                        s[2] += 1
                        s[3] += n
                        s[4] += h & 0x7FFFFFFF
                        s[5] += h >> 33
                        s[6] += chars
                    else:
                        sums[token] = [parent, kind, 1, n, h & 0x7FFFFFFF, h >> 33, chars]
            kept = [(host, t if v[1] != WORD else Tokens.word(*t), v) for host, sums in by_host.items() for t, v in sums.items() if v[1] != WORD or sums[v[0]][2:6] == v[2:6]]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int64()), *(pa.array([k[2][i] for k in kept], pa.int64()) for i in range(7))], ["host", "token", "parent", "kind", *VECTOR, "chars"])

    kinds = ", ".join(f"{c} bigint" for c in ("token", "parent", "kind", *VECTOR, "chars"))
    each = pages.mapInArrow(run, f"host string, {kinds}")
    return each.groupBy("host", "token", "parent", "kind").agg(*[F.sum(c).alias(c) for c in (*VECTOR, "chars")])


def deduce(found: dict[int, tuple[int, int, tuple, int]], share: float = 0.95) -> int:
    """token -> (parent, kind, vector, characters), of the tokens that are on enough of a host's pages -> the slot of the main text, PAGE for all of the page.

    Elements are kept where they nest: the element above is kept. What varies below an element is its characters without those of template words, which are in the class of the element around
    them. From the page inwards the slot is the container, once a page where it occurs, that holds at least `share` of what varies in the one around it; an article or
    main element needs half, and is not entered."""
    kept, left = {PAGE}, {t: f[0] for t, f in found.items() if f[1] != WORD and t != PAGE}
    while ready := [t for t, parent in left.items() if parent in kept]:
        kept.update(ready)
        for t in ready:
            del left[t]
    varies = {t: found[t][3] for t in kept}
    for parent, kind, vector, chars in found.values():
        if kind == WORD and parent in kept and found[parent][2] == vector:
            while parent in varies:
                varies[parent] -= chars
                parent = found[parent][0]
    below: dict[int, list[int]] = defaultdict(list)
    for t in kept:
        if t != PAGE:
            below[found[t][0]].append(t)
    slot = PAGE
    while found[slot][1] != MAIN_HOLDER:
        inner, todo = [], list(below[slot])
        while todo:  # containers below, through elements that are none
            t = todo.pop()
            if found[t][1] == ELEMENT:
                todo += below[t]
            elif found[t][2][0] == found[t][2][1]:
                inner.append(t)
        enough = [t for t in inner if varies[t] > 0 and varies[t] >= varies[slot] * (0.5 if found[t][1] == MAIN_HOLDER else share)]
        if not enough:
            break
        slot = max(enough, key=lambda t: (varies[t], t))
    return slot


def templates(pages: DataFrame, vectors: DataFrame, often: float = 0.5, share: float = 0.95) -> DataFrame:
    """(host, slot) of each host with two different pages or more. Tokens count if they are on at least `often` of the host's pages; so a host has at most 1 / often times the tokens of its mean page, and none is
    cut. Different pages are counted by their hashes, a row a page."""
    differ = pages.groupBy("host", F.xxhash64("html").alias("page")).agg(F.count(F.lit(1)).alias("copies")).groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1").select("host")
    whole = vectors.filter((F.col("kind") == HOLDER) & (F.col("token") == PAGE)).select("host", F.col("n_pages").alias("all_pages")).join(differ, "host", "left_semi")
    common = vectors.join(whole, "host").filter(F.col("n_pages") >= often * F.col("all_pages"))
    each = common.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "kind", *VECTOR, "chars")).alias("found"))

    def run(batches):
        for b in batches:
            got = [deduce({r["token"]: (r["parent"], r["kind"], tuple(r[c] for c in VECTOR), r["chars"]) for r in rows}, share) for rows in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(got, pa.int64())], ["host", "slot"])

    return each.mapInArrow(run, "host string, slot bigint")


def extract(page: str | None, slot: int | None, lists: bool = True) -> str:
    """The main text: white space inside a block becomes one space, blocks are joined by an empty line. slot: that of the host; None where none was found. Without one, and on pages that have no text in it,
    what lies in an article or main element counts, or else all of the page. lists: whether what names call boilerplate is left out."""
    number, inside = Tokens(), []
    all_ = [(path, text) for path, text in blocks(page) if text and not (lists and any(map(outside, path)))]
    if slot is not None and slot != PAGE:
        inside = [text for path, text in all_ if any(number.path(path[:k]) == slot for k in range(1, len(path) + 1))]
    return "\n\n".join(inside or (slot is None or slot != PAGE) and [t for path, t in all_ if any(name in MAIN for name, _, _ in path)] or [t for _, t in all_])


#: Pages of a batch that a worker holds at once as Python objects.
SLICE = 64


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, SLICE):
        yield batch.slice(i, SLICE)


def main_text(pages: DataFrame, broadcast_bytes: int = 16 << 20, salts: int = 16, lists: bool = True, share: float = 0.95) -> DataFrame:
    """pages (page_id, url, html, ...) -> (page_id, url, text): one row for each row, from whole pages.

    Null and empty html give an empty text; a null url, or one without ://, is a host of its own with an empty name. Copies of a page have the text of the page, however many there
    are; a host whose pages are all the same has no template. Extra columns are ignored; an empty table gives no rows. lists=False: by the template alone, without asking names.

    If all hosts' slots are within broadcast_bytes (a host's name and a number each) they travel with the tasks; beyond, pages are joined to them by host and a salt, so that a hot host is dealt over several tasks."""
    kind = pages.schema["page_id"].dataType.simpleString()
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    known = own.filter("html <> ''").select("host", "html")
    vectors = scratch(token_vectors(known, lists), "token_vectors")  # else pages would be read as tokens for each use
    by_host = scratch(templates(known, vectors, share=share), "templates")
    size = by_host.agg(F.sum(F.octet_length("host") + 8)).first()[0] or 0
    schema = f"page_id {kind}, url string, text string"

    def texts(b: pa.RecordBatch, slots) -> pa.RecordBatch:
        got = [extract(p, s, lists) for p, s in zip(b.column("html").to_pylist(), slots)]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string())], ["page_id", "url", "text"])

    if size <= broadcast_bytes:
        held = {r.host: r.slot for r in by_host.collect()}

        def run(batches):
            for whole in batches:
                for b in _sliced(whole):
                    yield texts(b, map(held.get, b.column("host").to_pylist()))

        return own.mapInArrow(run, schema)

    def run_joined(batches):
        for whole in batches:
            for b in _sliced(whole):
                yield texts(b, b.column("slot").to_pylist())

    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    spread = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(spread, ["host", "salt"], "left").select("page_id", "url", "html", "slot").mapInArrow(run_joined, schema)
