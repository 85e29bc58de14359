"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Parts that never belong
to an article (menus, forms, asides, adverts, notices, comments) are left out by
element, role, class or id. A name counts by its parts between hyphens; in an article that goes for the names of
comments, adverts and the like, on blocks that hold no more than half of its text. A form around the article or
most of the text is no noise. Over the lines that remain, text lengths outside links are
summed in windows of WINDOW lines: a line whose window rises to SURGE characters
opens a stretch, and the next line whose window holds none ends it. The stretch with most text is the
article, and with it every other that has as much when weighed by FAVOUR, and the lines between them.

``article`` and ``main`` elements and article bodies weigh on this. Inside them the text of links counts, as it
is the article's, and text counts FAVOUR times. If the first stretch lies for the most part in such elements,
surge and dive are sought among their lines alone, and lines at a stretch's edges that are in its element
go with it; cards beside a longer text are not taken.

Each page is handled on its own, in time linear in its length. Defined results: a
null or empty page has empty text; markup that ends early is read as far as it
goes; repeated rows and null keys keep their rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, SURGE, FAVOUR = 4, 80, 2
#: Characters from which a line that is mostly a link may end an article.
LINE = 40

#: The attributes are here where no value holds "<" or ">"; else _tag_end finds where they end.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?:(?P<attrs>(?:[^<>=]++|=\s*+(?:\"[^<>\"]*+\"|'[^<>']*+'|(?![\"'])))*+)>)?+", re.S)
ANGLE, STOP, QUOTE = re.compile(r"[<>]"), re.compile(r"[<>=]"), re.compile(r"\s*+([\"'])")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
#: Content that is not markup; nothing of it is shown as text of the page.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
NOISE_TAGS = frozenset("nav header footer aside form button menu dialog fieldset head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets".split()
)
#: Classes that also rule out an article element.
ASIDE_WORDS = frozenset("ad advert comment comments promo related reply sponsored teaser".split())
CONTAINERS = frozenset(("article", "main"))
#: Elements that may be set around a whole page; no noise if they hold the article or most of the text.
WRAPPING_TAGS = frozenset(("form", "fieldset"))
#: In an article, blocks that are noise by a whole name, or by a part of it that is among these words; blocks of text
#: by fewer. Names that only look like it are spared.
BLOCKS = frozenset("details div dl figure ol section table ul".split())
TEXT_BLOCKS = frozenset("p li blockquote dd dt h1 h2 h3 h4 h5 h6".split())
PART_WORDS = NOISE_WORDS - frozenset("header login menu modal notice notices search tags toolbar widget widgets".split())
TEXT_WORDS = frozenset("ads advert adverts advertisement advertising comment comments cookie cookies disqus newsletter promo promoted replies reply sponsored".split())
SPARED = frozenset(("ad-hoc",))
#: Their ids are made of a heading's words, so only a whole id names noise.
HEADED = frozenset("section h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _attributes(attrs: str) -> dict[str, str]:
    """Values in lower case by name in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    for key, *values in ATTRIBUTE.findall(attrs):
        out.setdefault(key.lower(), "".join(values).lower())
    return out


def _is_noise(name: str, attrs: str, in_article: bool = False) -> bool:
    if name in NOISE_TAGS:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    given = _attributes(attrs)
    if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in NOISE_ROLES:
        return True
    if in_article and name != "article" and name not in BLOCKS and name not in TEXT_BLOCKS:
        return False
    for key in ("class", "id"):
        names = set(given.get(key, "").split()) - SPARED
        if key == "id" and name in HEADED:
            parts = names
        else:
            parts = {x for n in names for x in re.split(r"[_-]+|(?<=[a-z])(?=\d)", n)}
        if name == "article":
            noise = parts & ASIDE_WORDS
        elif not in_article:
            noise = parts & NOISE_WORDS
        elif name in TEXT_BLOCKS:
            noise = parts & TEXT_WORDS
        else:
            noise = names & NOISE_WORDS or parts & PART_WORDS
        if noise:
            return True
    return False


def _is_body(attrs: str) -> bool:
    """An article's body by itemprop, class or id."""
    if "articlebody" not in attrs.lower():
        return False
    given = _attributes(attrs)
    return any("articlebody" in re.split(r"[\s_-]+", given.get(k, "")) for k in ("itemprop", "class", "id"))


def _tag_end(page: str, begin: int, dead: set[int], unclosed: dict[str, int]) -> int:
    """Where the ">" of a tag stands whose attributes begin there, or -1. Values in quotes, of any length,
    may hold "<" and ">"; if that leads to no end, the first ">" is taken.

    A page's calls share the "=" that lead to no end and, for each quote, from where on none follows, so
    that all of them together take time linear in the page."""
    at, path = begin, []
    while (stop := STOP.search(page, at)) and stop[0] != "<" and stop.start() not in dead:
        if stop[0] == ">":
            return stop.start()
        path.append(stop.start())
        at = stop.end()
        if value := QUOTE.match(page, at):
            at = value.end()
            close = page.find(value[1], at) if at < unclosed.get(value[1], len(page)) else -1
            if close < 0:
                unclosed[value[1]] = min(at, unclosed.get(value[1], at))
            elif page[close - 1] == "=" and page[close + 1 : close + 2].strip(" \t\n\r\f/>"):
                break  # the quote opens the value of another tag
            else:
                at = close + 1
    dead.update(path)
    first = ANGLE.search(page, begin)
    return first.start() if first and first[0] == ">" else -1


def _tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, attributes); raw elements are one token without a name."""
    out, at = [], 0
    closers: dict[str, re.Pattern] = {}
    dead: set[int] = set()
    unclosed: dict[str, int] = {}
    while m := TOKEN.search(page, at):
        name, attrs, at = (m["name"] or "").lower(), m["attrs"] or "", m.end()
        if name and m["attrs"] is None:
            end = _tag_end(page, at, dead, unclosed)
            if end < 0:
                continue
            attrs, at = page[at:end], end + 1
        if name in RAW and not m["end"] and not attrs.endswith("/"):
            closer = closers.setdefault(name, re.compile(rf"</{name}\b[^>]*>", re.I))
            close = closer.search(page, at)
            if close:
                out.append((m.start(), close.end(), "", False, ""))
                at = close.end()
                continue
            if name in ("script", "style"):
                out.append((m.start(), len(page), "", False, ""))
                break
        out.append((m.start(), at, name, bool(m["end"]), attrs))
    return out


def _matches(tokens: list[tuple]) -> dict[int, int]:
    """Start tag -> end tag, for each element name by itself, so that other elements may stay open."""
    open_, out = defaultdict(list), {}
    for k, (_, _, name, is_end, attrs) in enumerate(tokens):
        if name and is_end:
            if open_[name]:
                out[open_[name].pop()] = k
        elif name and name not in VOID and not attrs.endswith("/"):
            open_[name].append(k)
    return out


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, container) of each block; container 0 is the page."""
    tokens = _tokens(page)
    ends = _matches(tokens)
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    plain, link, container = 0, 0, 0
    # A wrapper may be named after a part beside the article; what holds the article is no noise.
    holds = [k for k, (_, _, name, is_end, attrs) in enumerate(tokens) if name in ("article", "main", "h1") and not is_end and not _is_noise(name, attrs)]
    closing: dict[int, tuple[int, bool]] = {}  # end tag -> container to return to, and whether it is in an article
    held: dict[int, int] = {}  # container -> characters of its text
    in_article = False
    at = skip_to = 0
    seen = [0]  # characters of text before each token
    for start, end, *_ in tokens:
        seen.append(seen[-1] + len(page[at:start].strip()))
        at = end
    at = 0

    def inside(k: int) -> int:
        return seen[ends[k] + 1] - seen[k + 1]

    def wraps(k: int) -> bool:
        return bisect(holds, ends[k]) > bisect(holds, k) or 2 * inside(k) > seen[-1]

    def spared(k: int, name: str) -> bool:
        """A part named like noise that holds the article or most of it."""
        if name in WRAPPING_TAGS:
            return wraps(k)
        return name not in NOISE_TAGS and (bisect(holds, ends[k]) > bisect(holds, k) or (in_article and 2 * inside(k) > held.get(container, seen[-1])))

    def flush() -> None:
        nonlocal plain
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((text, plain, container))
        parts.clear()
        plain = 0

    for k, (start, end, name, is_end, attrs) in enumerate(tokens):
        if start < skip_to:
            continue
        if at < start:
            parts.append(page[at:start])
            plain += 0 if link else len(page[at:start].strip())
        at = end
        if not name:
            continue
        if name not in INLINE:
            flush()
        if is_end:
            link = max(0, link - (name == "a"))
            container, in_article = closing.pop(k, (container, in_article))
        elif k in ends:
            if _is_noise(name, attrs, in_article) and not spared(k, name):
                flush() if name not in INLINE else None
                at = skip_to = tokens[ends[k]][1]
            elif name in CONTAINERS or _is_body(attrs):
                closing[ends[k]] = container, in_article
                container, in_article = k + 1, in_article or name != "main"
                held[container] = inside(k)
            link += name == "a"
            if skip_to > start and name == "a":
                link -= 1
    if at < len(page):
        parts.append(re.sub(r"<[A-Za-z/!][^<>]*\Z", "", page[at:]))
        plain += len(parts[-1].strip())
    flush()
    return out


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[start, end) of every stretch between a surge and a dive."""
    sums = [0] * (len(lengths) + window)
    for i in range(len(lengths) - 1, -1, -1):
        sums[i] = sums[i + 1] + lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
    out, i = [], 0
    while i < len(lengths):
        if sums[i] < surge or not lengths[i]:
            i += 1
            continue
        j = i + 1
        while j < len(lengths) and sums[j]:
            j += 1
        out.append((i, j))
        i = j
    return out


def stretch(lengths: list[int], sizes: list[int] | None = None, window: int = WINDOW, surge: int = SURGE) -> tuple[int, int, int]:
    """[start, end) of the stretch with most text, and its text; windows sum the lengths, the text is counted in sizes."""
    sizes = lengths if sizes is None else sizes
    best = max(((sum(sizes[i:j]), -i, j) for i, j in stretches(lengths, window, surge)), default=(0, 0, 0))
    return (-best[1], best[2], best[0]) if best[0] else (0, 0, 0)


def article(found: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], bool]:
    """([start, end) of the article's lines, in order, and whether elements weighed in); empty without a surge."""
    lengths = [len(text) if container else plain if 2 * plain >= len(text) else 0 for text, plain, container in found]
    weights = [FAVOUR * n if container else n for n, (_, _, container) in zip(lengths, found, strict=True)]
    start, end, weight = stretch(lengths, weights)
    if start == end:
        return [], False
    elements = 2 * sum(w for w, (_, _, c) in zip(weights[start:end], found[start:end], strict=True) if c) >= weight
    if elements:
        lengths = [n if container else 0 for n, (_, _, container) in zip(lengths, found, strict=True)]
    parts = stretches(lengths)
    most = max((sum(lengths[i:j]) for i, j in parts), default=0)
    kept: list[tuple[int, int]] = []
    for i, j in parts:
        if FAVOUR * sum(lengths[i:j]) < most:
            continue
        if elements:  # what is left of the elements at the edges
            while i and found[i - 1][2] and found[i - 1][2] == found[i][2]:
                i -= 1
            while j < len(found) and found[j][2] and found[j][2] == found[j - 1][2]:
                j += 1
        else:  # a last line that is mostly a link
            while j < len(found) and found[j][1] and len(found[j][0]) >= LINE:
                j += 1
        if kept and (i <= kept[-1][1] or not elements or found[i][2] == found[kept[-1][1] - 1][2]):
            kept[-1] = kept[-1][0], max(j, kept[-1][1])
        else:
            kept.append((i, j))
    return kept, elements


def main_text(page: str | None) -> str:
    found = lines(page or "")
    kept, _ = article(found)
    if not kept:  # no surge: a page of a few words
        return " ".join(text for text, plain, container in found if container or (2 * plain >= len(text) and plain))
    return " ".join(text for start, end in kept for text, _, _ in found[start:end])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of each page."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
