"""Main text of web pages: markup, and a host suffix array that finds the boilerplate markup doesn't name.

1. Each page is read once into blocks of text; what lies in menus, headers, footers, sidebars, notices, adverts, forms,
   scripts, styles or reader comments (by element, role, class or id) is dropped.  A class counts as a whole: each of
   its parts must be in NAMES or PLACES, and one in NAMES; it never drops an outermost ``article`` or ``main``.
2. The blocks' tokens are the page's stream, and the streams of a host are compared by their suffixes.  Order matters
   only as far as it tells repeated strings, so suffixes that agree over their first tokens are one group of an
   aggregation on (host, hash of those tokens), whose keys spread a host with a third of all pages over all tasks.
   * A page that doesn't mark its main text (``article``, ``main``, role main) loses every token covered by DEPTH tokens that
     another page of the host has too (marked pages, all their blocks, are compared with it); the unique runs stay.
   * A page that marks its main text loses the blocks in it (of DEPTH tokens or more) that half of the host's
     different main texts have, MOST_COMMON of them at least.  Suffixes that begin a block, down to its end, say that.  Articles are
     copied and quote each other, so repetition by fewer, or of more than half of an article, removes nothing there.

Markup is read as browsers do, in time proportional to the page: a quoted value may hold ``>``, a quote that isn't closed is
none, and a tag, comment or script that isn't closed lasts until the end.

Defined results: null, empty and markup-only html give the empty text; a null url has the host ``''``; rows that
repeat a page (same page_id, url and html) are one page and don't make its text repeated; a null page_id is carried
along; very long pages are read whole; extra columns are ignored, whatever their names; an empty table gives an empty
result.  White space is Unicode white space.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm.common import load, written
from tessera.llm.url_filter import host_of

DEPTH, MOST_COMMON, SALTS = 8, 8, 64
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements without content, whose content is no text, that end a block, that hold no main text, that mark it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template textarea title iframe svg math object canvas audio video xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OTHER = frozenset("nav header footer aside form button select menu dialog head fieldset".split())
MAIN = frozenset(("article", "main"))
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies footer header masthead menu modal nav navbar "
    "navigation newsletter notice notification paywall popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that stand beside those in a class and only say where or how large.
PLACES = frozenset("a area bar block body bottom box btn button buttons container content copy global item items left link links list main page panel posts primary right secondary section site text thread top wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())


def _names_other(value: str) -> bool:
    for token in value.split():
        parts = _PART.findall(token)
        if any(p in NAMES for p in parts) and all(p in NAMES or p in PLACES for p in parts):
            return True
    return False


def _marks(name: str, attributes: str, nested: bool) -> tuple[bool, bool]:
    """Whether an element holds no main text, and whether it marks it.  nested: it lies in main text."""
    other, main = name in OTHER, name in MAIN
    if "=" in attributes:
        for k, a, b, c in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if k.lower() == "role":
                other, main = other or value in ROLES, main or value == "main"
            elif name not in ("body", "html") and (nested or name not in MAIN):
                other = other or _names_other(value)
    return other, main


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The blocks that may be main text, and whether the page marks them."""
    texts, mains, seen = read(page)
    return [t for t, m in zip(texts, mains, strict=True) if m or not seen], seen


def read(page: str | None) -> tuple[list[str], list[bool], bool]:
    """All blocks outside of what holds no main text, whether each is in marked main text, and whether the page marks any."""
    page = page or ""
    texts: list[str] = []
    inside: list[bool] = []
    now: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    places: dict[str, list[int]] = {}  # of open elements, by name
    walls: list[int] = []  # places of open blocks
    others = mains = at = 0
    seen = False
    size = len(page)

    def end() -> None:
        if now:
            text = " ".join("".join(now).split())
            now.clear()
            if text:
                texts.append(text)
                inside.append(mains > 0)

    def pop() -> None:
        nonlocal others, mains
        name, other, main = stack.pop()
        others -= other
        mains -= main
        places[name].pop()
        if walls and walls[-1] == len(stack):
            walls.pop()

    while at < size:
        begin = page.find("<", at)
        while begin >= 0 and not (page[begin + 1 : begin + 2].isalpha() and page[begin + 1].isascii() or page[begin + 1 : begin + 2] in ("/", "!", "?")):
            begin = page.find("<", begin + 1)  # a mere character
        text = page[at : begin if begin >= 0 else size]
        if text and not others:
            now.append(html.unescape(text) if "&" in text else text)
        if begin < 0:
            break
        second = page[begin + 1]
        if page.startswith("<!--", begin):
            short = next((k for k in (5, 6) if page[begin : begin + k] in ("<!-->", "<!--->")), 0)
            stop = page.find("-->", begin + 4)
            at = begin + short if short else stop + 3 if stop >= 0 else size
            continue
        closing = second == "/"
        m = (_END_TAG if closing else _TAG).match(page, begin) if second not in "!?" else None
        if not m:
            stop = page.find(">", begin)
            named = second not in "!?/" or page[begin + 2 : begin + 3].isalpha() and closing
            at = size if stop < 0 or named else stop + 1
            continue
        at, name = m.end(), m[1].lower()
        attributes = "" if closing else m[2]
        if name in OPAQUE:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{name}\s*+>", re.I).search(page, at)
                at = stop.end() if stop else size
            continue
        if name == "br":
            now.append(" ")
            continue
        if name in BLOCK:
            end()
        if name in VOID:
            continue
        if not closing:
            if name == "p" and stack and stack[-1][0] == "p" and not stack[-1][1]:
                pop()
            other, main = _marks(name, attributes, mains > 0)
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                walls.append(len(stack))
            stack.append((name, other, main))
            others += other
            mains += main
            seen = seen or (main and not others)
            continue
        i = places[name][-1] if places.get(name) else -1
        if i >= 0 and (name in BLOCK or not walls or walls[-1] < i):  # an inline element doesn't close the block around it
            while len(stack) > i:
                pop()
    end()
    return texts, inside, seen


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")


def _signed(x: int) -> int:
    return x - (1 << 63)


def _parsed(pages: DataFrame, depth: int) -> DataFrame:
    """Each page read once: texts and mains by block, the hash of its main text, and of its long blocks there (else null)."""
    names = ["page_id", "url", "host", "uid", "marked", "texts", "mains", "own", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for h in b.column(2):
                texts, mains, seen = read(h.as_py())
                body = [t for t, m in zip(texts, mains, strict=True) if m] if seen else []
                keys = [_signed(xxh3_64_intdigest(t)) if t.count(" ") >= depth - 1 else None for t in body]
                for o, x in zip(out, (seen, texts, mains, _signed(xxh3_64_intdigest("\n".join(body))), keys), strict=True):
                    o.append(x)
            kinds = (pa.bool_(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], names)

    keyed = _pages(pages).withColumns({"host": host_of(F.col("url")), "uid": F.xxhash64("page_id", "url", "html")})
    return keyed.mapInArrow(run, "page_id long, url string, host string, uid long, marked boolean, texts array<string>, mains array<boolean>, own long, keys array<long>")


def _common(marked: DataFrame) -> DataFrame:
    """host, common: hashes of the blocks that half of the host's different main texts have.

    A host has at most twice as many of them as its main texts have blocks on average.
    """
    hosts = marked.select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MOST_COMMON)
    have = marked.select("host", "own", F.explode("keys").alias("key")).where("key IS NOT NULL").distinct().groupBy("host", "key").agg(F.count("*").alias("c")).where(F.col("c") >= MOST_COMMON)
    return have.join(hosts, "host").where("2 * c >= n").groupBy("host").agg(F.collect_list("key").alias("common"))


def extract(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """page_id, url, text, n_chars, one row per input row."""
    names, schema = ["page_id", "url", "text", "n_chars"], "page_id long, url string, text string, n_chars long"

    def made(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    def uncommon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for texts, mains, keys, common in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                body = [t for t, m in zip(texts, mains, strict=True) if m]
                if common:
                    common = set(common)
                    rest = [t for t, k in zip(body, keys, strict=True) if k not in common]
                    tokens = lambda ts: sum(t.count(" ") + 1 for t in ts)
                    body = rest if 2 * tokens(rest) >= tokens(body) else body
                out.append("\n".join(body))
            yield made(b.column(0), b.column(1), out)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, uid, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tokens = " ".join(page or ()).split(" ")
                n = len(tokens) - depth + 1
                if n > 0:
                    hashes = [_signed(xxh3_64_intdigest(" ".join(tokens[i : i + depth]))) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([uid] * n, pa.int64()), pa.array(hashes, pa.int64()), pa.array(range(n), pa.int32())], ["host", "uid", "h", "at"])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                covered = {i + d for i in places or () for d in range(depth)}
                at, kept = 0, []
                for block in page or ():
                    tokens = block.split(" ")
                    rest = [t for i, t in enumerate(tokens) if at + i not in covered]
                    at += len(tokens)
                    if rest:
                        kept.append(" ".join(rest))
                out.append("\n".join(kept))
            yield made(b.column(0), b.column(1), out)

    parsed = written(_parsed(pages, depth), "pages")
    marked = parsed.where("marked")
    # a table, so that its size is known: only a large one makes the pages move
    salted = written(_common(marked), "common").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a host's pages go to many tasks
    dealt = marked.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    sure = dealt.select("page_id", "url", "texts", "mains", "keys", "common").mapInArrow(uncommon, schema)
    open_ = parsed.where("NOT marked")
    if open_.isEmpty():
        return sure
    places = "host string, uid long, h long, at int"
    streams = written(open_.select("host", "uid", "texts").dropDuplicates(["host", "uid"]).mapInArrow(suffixes, places), "suffixes")
    others = marked.select("host", "uid", "texts").join(open_.select("host").distinct(), "host", "left_semi").mapInArrow(suffixes, places)
    shared = streams.unionByName(others).groupBy("host", "h").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where("a < b").select("host", "h")
    found = streams.join(shared, ["host", "h"]).groupBy("uid").agg(F.collect_set("at").alias("places"))
    rest = open_.join(found, "uid", "left").select("page_id", "url", "texts", "places").mapInArrow(unique, schema)
    return sure.unionByName(rest)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
