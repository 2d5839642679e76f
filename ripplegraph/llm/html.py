"""Main text of web pages: templates deduced by nested equivalence classes, the article by its mark where there is one.

A page's markup is read into a sequence of tokens: tags by their path, and whole blocks of
text. The template of every host is deduced from its pages with different contents (copies
of a page prove nothing):

1. Tokens that occur in the same pages the same number of times form an equivalence class.
   It needs enough tokens, enough pages, and a share of the pages of the slot that it lies in.
2. A class is ordered if its tokens come in one order, time after time, on all of its pages.
   Tokens out of order are taken out of it; if too few stay, its unbroken runs are classes.
3. Classes are nested: of two that cross on a page the one of fewer pages waits, and so does
   a class that lies in another. If each of its tokens lies in one slot, it comes back in parts.
4. Tokens between two tokens of a class lie in its slot there and have a role of their own:
   they are counted anew, slot by slot, until no class is found.

What lies in slots, or outside of all classes, is extracted. Where a page marks its article
(or main part), the mark says which of the blocks are the text, and none of them is taken
for template; where it marks none, the blocks that the template does not cover are. Menus,
notices, adverts, forms and comments are left out of both. Occurrence vectors are sums of
hashes, so that no host's tokens meet in one task.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, release, slices, stored, table

#: A class is valid with so many tokens, so many pages, and this share of the pages of its slot (of its host, if it lies in none).
MIN_TOKENS, MIN_PAGES, MIN_SHARE = 3, 3, 0.5
#: Of a page without a marked article, blocks whose characters are links by more than this share are menus.
LINK_SHARE = 0.7

_SCAN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*|[^>]*)(>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[a-z]+")
_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "textarea", "title", "select", "object", "audio", "video", "canvas", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_OUT = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "head", "fieldset"}
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "widget", "login", "search", "skip",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
_NEVER_OUT = {"html", "body", "main"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _excluded(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _OUT:
        return True
    if not attributes.strip() or tag in _NEVER_OUT:
        return tag == "header" and not in_article
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if found.get("role") in _ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    for name in names:
        words = _TOKEN.findall(name)
        # "ad", "ad-slot" and "site-footer" are such parts; "no-sidebar" and "with-comments" say what a part has
        if words and words[0] not in ("no", "with", "has", "without", "not") and (words[0] in _NAMES or words[-1] in _NAMES):
            return True
    return tag == "header" and not in_article


class Page:
    """blocks: (article, main or nothing, path, text, share of link characters); sequence: tokens in page order; at: where the blocks are in it.

    A path is a hash of its parent's and the tag, so that pages of any depth are read in linear time.
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, int, str, float]] = []
        self.sequence: list[int] = []
        self.at: list[int] = []
        self._marked = False
        self._stack: list[tuple[str, bool, str, int]] = []  # tag, excluded, article, path
        self._levels: list[int] = []  # places in the stack of what isn't inline
        self._opened: Counter[str] = Counter()  # by tag, of what isn't inline
        self._inline: list[Counter[str]] = [Counter()]  # by tag, of what is, level by level
        self._text: list[str] = []
        self._linked = 0
        self._links = 0
        self._read(source or "")

    def _top(self) -> tuple[str, bool, str, int]:
        return self._stack[-1] if self._stack else ("", False, "", 0)

    def _cut(self, at: int) -> None:
        """Close all from this place of the stack on."""
        for tag, *_ in self._stack[at:]:
            self._links -= tag == "a"
            if tag not in _INLINE:
                self._opened[tag] -= 1
        while self._levels and self._levels[-1] >= at:
            self._levels.pop()
            self._inline.pop()
        for tag, *_ in self._stack[at:]:
            if tag not in _INLINE:
                break
            self._inline[-1][tag] -= 1
        del self._stack[at:]

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._top()[2], self._top()[3], text, min(1.0, self._linked / len(text))))
                self.at.append(len(self.sequence))
                self.sequence.append(_hash(f"{self._top()[3]}>{text}"))
            self._text, self._linked = [], 0

    def _say(self, text: str) -> None:
        if text and not self._top()[1]:
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _close(self, tag: str) -> None:
        if tag in _INLINE:
            if not self._inline[-1][tag]:
                return  # it closes nothing outside of its block
        elif not self._opened[tag]:
            return
        else:
            self._flush()
        at = len(self._stack) - 1
        while self._stack[at][0] != tag:
            at -= 1
        self._cut(at)

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self._flush()
            closes = _CLOSES.get(tag, ())
            while self._levels and ((above := self._stack[self._levels[-1]][0]) == "p" or above in closes):
                self._cut(self._levels[-1])
        _, out, article, path = self._top()
        if tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", attributes):
            article = "article" if tag == "article" else article or "main"
            self._marked |= tag in ("article", "main")
        gone = out or _excluded(tag, attributes, bool(article))
        path = _hash(f"{path}/{tag}")
        self.sequence.append(path)
        if tag not in _VOID:
            if tag in _INLINE:
                self._inline[-1][tag] += 1
            else:
                self._levels.append(len(self._stack))
                self._opened[tag] += 1
                self._inline.append(Counter())
            self._stack.append((tag, gone, article, path))
            self._links += tag == "a"

    def _read(self, source: str) -> None:
        at = 0
        while (m := _SCAN.search(source, at)) is not None:
            self._say(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag or not m[4]:
                continue  # a comment or declaration, or a tag that the page's end cuts off
            if m[1]:
                if tag == "br":
                    self._flush()
                self._close(tag)
                continue
            if tag in _RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if tag not in _INLINE:
                    self._flush()
                at = end.end() if end else len(source)
                continue
            self._open(tag, m[3])
        self._say(source[at:])
        self._flush()

    def article(self) -> str | None:
        """The marked article's text, or else the main part's; None if neither is marked or has text while other parts have some."""
        for kind in ("article", "main"):
            if found := [b[2] for b in self.blocks if b[0] == kind]:
                return " ".join(found)
        return "" if self._marked and not self.blocks else None

    def tokens(self) -> list[tuple[int, int]]:
        """Hash and count of every tag path and block of text."""
        return list(Counter(self.sequence).items())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


READ = "page_id long, url string, text string, host string, content long, tokens array<long>, at array<int>, blocks array<string>"


def read_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """READ of every page: text is final where an article is marked; blocks (null for menus) only where none is."""
    fields = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                columns: list[list] = [[] for _ in fields]
                for page_id, url, source in zip(*(part.column(i).to_pylist() for i in range(3))):
                    page = Page(source)
                    text = page.article()
                    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0]
                    blocks = None if text is not None else [x if linked <= LINK_SHARE else None for *_, x, linked in page.blocks]
                    row = (page_id, url, text, host, _hash(source or ""), page.sequence, page.at, blocks)
                    for column, value in zip(columns, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, fields)], names=names)
        release()

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, READ)


class Placed:
    """The tokens of a page under its host's template: of each its slot (0: none), which occurrence of that (0: none), and whether the template covers it.

    template: rows of templates(), in any order.
    """

    def __init__(self, tokens: list[int], template: list[dict]):
        self.tokens = tokens
        self.slot, self.gap, self.covered = [0] * len(tokens), [0] * len(tokens), [False] * len(tokens)
        levels: dict[int, dict] = {}
        for x in template:
            levels.setdefault(x["level"], {})[x["within"], x["t"]] = x
        gaps = count(1)
        for _, level in sorted(levels.items()):
            opened: dict[int, list] = {}  # by gap: the slots that are open in it, the innermost last
            for j, t in enumerate(tokens):
                if self.covered[j]:
                    continue
                inside = opened.setdefault(self.gap[j], [])
                x = level.get((self.slot[j], t))
                if x is None:
                    if inside:
                        self.slot[j], self.gap[j] = inside[-1]
                    continue
                self.covered[j] = True
                if x["place"] and inside:
                    inside.pop()
                if x["place"] < x["size"] - 1:
                    inside.append((x["slot"], next(gaps)))

    def left(self) -> Iterator[tuple[int, int, int, int]]:
        """Position, slot, gap and token of what isn't covered."""
        return ((j, s, g, t) for j, (s, g, t, c) in enumerate(zip(self.slot, self.gap, self.tokens, self.covered)) if not c)


def _disordered(keys: list) -> list[int]:
    """Places that a longest increasing part of the keys leaves out."""
    if all(a < b for a, b in zip(keys, keys[1:])):
        return []
    tails: list = []
    ends: list[int] = []
    before = [-1] * len(keys)
    for j, key in enumerate(keys):
        at = bisect_left(tails, key)
        before[j] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(key)
            ends.append(j)
        else:
            tails[at], ends[at] = key, j
    kept, j = set(), ends[-1]
    while j >= 0:
        kept.add(j)
        j = before[j]
    return [j for j in range(len(keys)) if j not in kept]


def _counted(page: Placed, _: list[dict], content: int) -> Iterator[tuple]:
    """Slot, token, content, count and first position of every token."""
    seen: dict[tuple, list[int]] = {}
    for j, slot, _, t in page.left():
        seen.setdefault((slot, t), [0, j])[0] += 1
    return ((slot, t, content, n, first) for (slot, t), (n, first) in seen.items())


def _unordered(page: Placed, candidates: list[dict], _: int) -> Iterator[tuple]:
    """Class, token, whether it is out of order (or in another gap than the class's first), whether another token than the class's next one follows it."""
    by_token = {(x["within"], x["t"]): (x["class"], x["first"]) for x in candidates}
    follows: dict[int, dict] = {}
    for x in sorted(candidates, key=lambda x: x["first"]):
        follows.setdefault(x["class"], {})[x["t"]] = None
    for order in follows.values():
        order.update(zip(list(order), [*list(order)[1:], None]))
    times: Counter = Counter()
    found: dict[int, list] = {}
    for _, slot, gap, t in page.left():
        if hit := by_token.get((slot, t)):
            times[slot, t] += 1
            found.setdefault(hit[0], []).append(((times[slot, t], hit[1]), gap, t))
    for name, seen in found.items():
        first = next(iter(follows[name]))
        gaps = {key[0]: gap for key, gap, t in seen if t == first}
        out = {seen[j][2] for j in _disordered([key for key, *_ in seen])} | {t for key, gap, t in seen if gap != gaps.get(key[0])}
        ends = {t for (_, gap, t), (_, gap_after, after) in zip(seen, [*seen[1:], (None, None, None)]) if follows[name][t] is not None and (after != follows[name][t] or gap_after != gap)}
        yield from ((name, t, t in out, t in ends) for t in out | ends)


def _waiting(page: Placed, candidates: list[dict], _: int) -> Iterator[tuple]:
    """Class, whether it crosses one of more pages (or else more tokens); if not, it lies in one of as many pages or around one of more."""
    by_token = {(x["within"], x["t"]): x for x in candidates}
    crossing: set[int] = set()
    nested: set[int] = set()
    opened: dict[int, list] = {}  # by gap: rank and class of occurrences that are open
    for _, slot, gap, t in page.left():
        x = by_token.get((slot, t))
        if x is None or x["class"] in crossing:
            continue
        inside = opened.setdefault(gap, [])
        me = (-x["support"], -x["size"], x["class"])
        if x["place"] == 0:
            while inside and inside[-1][2] in crossing:
                inside.pop()
            if inside:
                nested.add(x["class"] if me[0] >= inside[-1][0] else inside[-1][2])
            inside.append(me)
        else:
            above = []
            while inside and inside[-1] != me:
                if (other := inside.pop())[2] not in crossing:
                    above.append(other)
            if above and min(above) < me:
                crossing.add(x["class"])
                if inside:
                    inside.pop()
                inside += reversed(above)
                continue
            crossing.update(other[2] for other in above)
        if x["place"] == x["size"] - 1 and inside:
            inside.pop()
    return ((name, name in crossing) for name in crossing | nested)


def _by_page(pages: DataFrame, template: DataFrame | None, candidates: DataFrame | None, look: Callable, schema: str) -> DataFrame:
    """host and what look(Placed, candidates of the host, content) yields of every page."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple] = {}
            hosts: list[str] = []
            columns: list[list] = [[] for _ in names]
            for j, (host, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if host not in known:
                    known[host] = tuple(batch.column(i)[j].as_py() or [] for i in (3, 4))
                for row in look(Placed(batch.column(2)[j].values.tolist(), known[host][0]), known[host][1], content):
                    hosts.append(host)
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["host", *names])
        release()

    joined = _beside(_beside(pages, template, "template", "left"), candidates, "candidates", "left" if candidates is None else "inner")
    return joined.select("host", "content", "tokens", "template", "candidates").mapInArrow(run, f"host string, {schema}")


def _beside(pages: DataFrame, rows: DataFrame | None, name: str, how: str) -> DataFrame:
    """Each page with all rows of its host, as an array: a class is no larger than a page, and few classes hold for a large share of the pages."""
    if rows is None:
        return pages.withColumn(name, F.lit(None).cast("array<struct<t:long>>"))
    return pages.join(rows.groupBy("host").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "host"))).alias(name)), "host", how)


TEMPLATE = ["host", "within", "t", "class", "support", "place", "size", "slot", "level"]


def _candidates(pages: DataFrame, template: DataFrame | None, slots: DataFrame, waiting: DataFrame | None) -> DataFrame:
    """host, within, t, vector, support, class, first, least: tokens by class; first is the position on the page of the least content hash, the same page for a class.

    A class that waits, and whose tokens each lie in one slot on all pages, comes back as a
    class in each of these slots, of any number of tokens; all others have MIN_TOKENS at least.
    """
    counts = _by_page(pages, template, None, _counted, "within long, t long, content long, n int, first int")
    part = F.xxhash64("content", "n").cast("decimal(38,0)")
    vectors = counts.groupBy("host", "within", "t").agg(F.sum(part).alias("vector"), F.count("*").alias("support"), F.min_by("first", "content").alias("first")).where(F.col("support") >= MIN_PAGES)
    vectors = vectors.join(slots, ["host", "within"]).where(F.col("support") >= MIN_SHARE * F.col("pages"))
    if waiting is None:
        vectors = vectors.withColumn("least", F.lit(MIN_TOKENS))
    else:
        before = waiting.select("host", "t", "vector", "support", F.col("class").alias("of"), F.col("size").alias("of_size"))
        vectors = vectors.join(before, ["host", "t", "vector", "support"], "left")
        # tokens of no such class are dealt by themselves
        vectors = vectors.withColumn("stay", F.when(F.col("of").isNotNull(), F.count("*").over(Window.partitionBy("host", F.coalesce("of", F.xxhash64("within", "t"))))))
        vectors = vectors.withColumn("least", F.when(F.col("stay") == F.col("of_size"), 1).otherwise(MIN_TOKENS))
    classes = vectors.withColumn("class", F.xxhash64("host", "within", "vector", "support"))
    of_class = Window.partitionBy("class")
    sized = classes.withColumn("size", F.count("*").over(of_class)).withColumn("least", F.min("least").over(of_class))
    return sized.where(F.col("size") >= F.col("least")).select("host", "within", "t", "vector", "support", "class", "first", "least")


def _ordered(pages: DataFrame, template: DataFrame | None, candidates: DataFrame) -> DataFrame:
    """The classes without tokens that are out of order on any page, or else their unbroken runs; place and size say a token's place in its class."""
    marks = _by_page(pages, template, candidates.drop("vector"), _unordered, "class long, t long, out boolean, ends boolean")
    marks = marks.groupBy("host", "class", "t").agg(F.max("out").alias("out"), F.max("ends").alias("ends"))
    of_class = Window.partitionBy("class")
    seen = candidates.join(marks, ["host", "class", "t"], "left").fillna(False, ["out", "ends"])
    enough = F.col("kept") >= F.col("least")
    seen = seen.withColumn("kept", F.sum((~F.col("out")).cast("int")).over(of_class)).where(~F.col("out") | ~enough)
    runs = F.sum(F.col("ends").cast("int")).over(of_class.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("run", F.when(enough, 0).otherwise(F.coalesce(runs, F.lit(0))))
    of_run = Window.partitionBy("class", "run")
    sized = seen.withColumn("size", F.count("*").over(of_run)).withColumn("place", F.row_number().over(of_run.orderBy("first")) - 1)
    return sized.where(F.col("size") >= F.col("least")).select("host", "within", "t", F.xxhash64("class", "run").alias("class"), "support", "place", F.col("size").cast("int").alias("size"), "vector")


def templates(read: DataFrame) -> DataFrame:
    """host, within, t, class, support, place, size, slot, level: the tokens of the valid classes of every host.

    place is a token's place in its class of that size; slot what lies between it and the
    next; within the slot (or 0, none) that the class itself lies in; level the round that
    found it. A class needs MIN_SHARE of the pages of that slot's class, or of its host's
    pages: the template of a kind of page that covers less stays in the text.
    """
    spark = read.sparkSession
    pages = stored(read.select("host", "content", "tokens").dropDuplicates(["host", "content"]), "page-tokens")
    slots = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("host", F.lit(0).cast("long").alias("within"), "pages")
    slots = stored(slots, "page-hosts")
    found: DataFrame | None = None
    open_hosts = slots.select("host")
    waiting: DataFrame | None = None
    for level in count(1):
        open_pages = pages.join(open_hosts, "host", "left_semi")
        candidates = stored(_candidates(open_pages, found, slots, waiting), "page-classes")
        ordered = stored(_ordered(open_pages, found, candidates), "page-classes")
        discard(candidates)
        if ordered.isEmpty():
            discard(ordered)
            if waiting is not None:
                discard(waiting)
            break
        marks = _by_page(open_pages, found, ordered.drop("vector"), _waiting, "class long, crosses boolean").groupBy("host", "class").agg(F.max("crosses").alias("crosses"))
        # where all wait, as each lies in another on some page, those that cross none are next
        ready = ordered.join(marks, ["host", "class"], "left").withColumn("outer", F.max(F.col("crosses").isNull()).over(Window.partitionBy("host")))
        ready = ready.where(F.col("crosses").isNull() | (~F.col("outer") & ~F.col("crosses")))
        slot = F.xxhash64("class", "place", F.lit(level))
        new = stored(ready.drop("vector", "crosses", "outer").withColumns({"slot": slot, "level": F.lit(level)}).select(*TEMPLATE), "page-templates")
        if waiting is not None:
            discard(waiting)
        waiting = stored(ordered.join(new.select("class").distinct(), "class", "left_anti"), "page-classes")
        discard(ordered)
        slots = slots.union(new.select("host", "slot", "support"))
        open_hosts = new.select("host").distinct()
        found = new if found is None else found.union(new)
    discard(pages)
    return spark.createDataFrame([], "host string, within long, t long, class long, support long, place int, size int, slot long, level int") if found is None else found


def extract(pages: DataFrame, **columns: str) -> DataFrame:
    """page_id, url, text, n_chars, template_tokens (how many of its tags and blocks its host's template covers) of every page.

    A null or empty page has an empty text. A page that breaks off counts as far as it
    comes; a tag that it cuts off is dropped. A very long or deep page is read whole, in
    linear time. Repeated rows each get their row; null ids and urls are kept. Other columns,
    whatever their names, are not read.
    """
    read = stored(read_pages(pages, **columns), "pages")
    names = ["page_id", "url", "text", "template_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list] = {}
            texts: list[str | None] = []
            covered: list[int] = []
            marked = batch.column(2).is_valid().to_pylist()
            for j, host in enumerate(batch.column(3).to_pylist()):
                if host not in known:
                    known[host] = batch.column(7)[j].as_py() or []
                page = Placed(batch.column(4)[j].values.tolist(), known[host])
                covered.append(sum(page.covered))
                texts.append(None if marked[j] else " ".join(x for i, x in zip(batch.column(5)[j].as_py(), batch.column(6)[j].as_py()) if x is not None and not page.covered[i]))
            text = batch.column(2).cast(pa.string())
            text = text if all(marked) else pc.coalesce(text, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), text, pa.array(covered, pa.int64())], names=names)
        release()

    found = _beside(read, templates(read), "template", "left").select("page_id", "url", "text", "host", "tokens", "at", "blocks", "template")
    done = found.mapInArrow(run, "page_id long, url string, text string, template_tokens long")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_tokens")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
