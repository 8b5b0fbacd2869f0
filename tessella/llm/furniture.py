"""Problem 1: tell a page's main body from the furniture of its site.

The layout-aware renderer gives the visible text of each source line and how it is laid out.  It emits everything that
is visible, so a decision about each rendered line follows.  No word of any language is known beforehand: what a line is
comes from its layout (runs of brief lines, separated items, paths, links, labels of lists) and from counts over all
pages: the menu items and lines of the site; the menu items, brief phrases and longer notices that many sites share; the
phrases after which titles of other pages follow; and the section headings of pages in general, which stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, page_key, site_key, small
from tessella.llm.render import Line, render, source_lines

_SEPARATED = re.compile(r"\s+[|·•]\s+")
_CRUMBS = re.compile(r"\s+(?:[/»›>→]|::)\s+")
_MARK = re.compile(r"^(?:[*•+\-–»›>◦▪]\s+|»)")
_MARKDOWN_LINK = re.compile(r"\[([^\][]+)\]\([^()\s]*\)")
_HEADING = re.compile(r"^(#{1,6}\s+|={2,6}\s*)")
_SENTENCE_END = re.compile(r"[.!?;:…][\"'”’»)\]]*$")
_OF = re.compile(r"\s+(of|von|de|des|du|del|in|bei)\s+\S+$")
_SIGNS = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
_ASCII_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
_LABEL = re.compile(r"([^\W\d][^:,.|]{1,20}):((?:[^,.:;|\d]+,){2,}[^,.:;|\d]+)$")
_STOPS = re.compile(r"[.;:!?…]")
_NUMBER_ITEM = re.compile(r"\d+[.)]\s")
_MEASURE = re.compile(r"\d\s?(km|m|ft|%|°|h)\b|:\s|\d,\d{3}|\d\.\d")


def item(text: str) -> str:
    """A menu item as it is compared: lower case, without marks and outer signs."""
    return _MARK.sub("", text.strip()).strip(" \t|·•☰+▾▸[]()").casefold()


def heading(text: str) -> str:
    """A heading as it is compared: without marks, numbers and what it is a heading of."""
    return _OF.sub("", re.sub(r"^[#=\s\d.]+|[=\s]+$", "", text).casefold())


def _slug(text: str) -> str:
    return re.sub(r"[\W_]+", "-", text.casefold()).strip("-")


def _brief(text: str, words: int = 4, chars: int = 32) -> bool:
    return 0 < len(text) <= chars and len(text.split()) <= words and not _SENTENCE_END.search(text) and not _HEADING.match(text) and "|" not in text


def _parts(text: str) -> list[str] | None:
    """The items of a line that is nothing but items: links in brackets, or parted by bars or dots."""
    if text.startswith("|") or not ("|" in text or "·" in text or "•" in text or "](" in text):
        return None  # a table row, or nothing that parts
    links = _MARKDOWN_LINK.findall(text)
    if len(links) > 1 and not _MARKDOWN_LINK.sub("", text).strip(" |·•*-"):
        return [item(x) for x in links]
    parts = [item(p) for p in _SEPARATED.split(text)]
    return parts if len(parts) > 1 and all(_brief(p) for p in parts) else None


def menu_items(lines: list[Line]) -> list[str]:
    """Items of lines laid out as menus: links that are list items, three or more brief items in a line, runs of brief
    lines; votes for the menus of the site and of sites in general."""
    out: list[str] = []
    shown = [x for x in lines if x.text]
    for x in shown:
        if x.linked and x.item and _brief(item(x.text)):
            out.append(item(x.text))
        elif (parts := _parts(x.text)) and len(parts) > 2 and not any(_MEASURE.search(p) for p in parts):
            out += parts
    k = 0
    while k < len(shown):
        e = k
        while e < len(shown) and len(shown[e].text) < 48 and _brief(item(shown[e].text)) and not _HEADING.match(shown[e].text) and not _MEASURE.search(shown[e].text):
            e += 1
        if e - k >= 4:
            out += [item(x.text) for x in shown[k:e]]
        k = max(e, k + 1)
    return out


def _segmented(text: str, phrases: frozenset[int], menu: frozenset[str], most: int = 4) -> tuple[int, float]:
    """How many known phrases and items a line falls into, and the share of its words that they cover."""
    words = [w.strip("|·•+[]") or w for w in text.casefold().split()]
    k = found = covered = 0
    while k < len(words):
        for n in range(min(most, len(words) - k), 0, -1):
            part = " ".join(words[k : k + n])
            if part in menu or phrase_key(part) in phrases:
                found, covered, k = found + 1, covered + n, k + n
                break
        else:
            k += 1
    return found, covered / max(1, len(words))


def site_words(url: str | None) -> frozenset[str]:
    """The words of a host's name, in which a site's own name is written."""
    labels = (urlsplit(url or "").hostname or "").casefold().split(".")
    return frozenset(w for w in labels[-2].split("-") if w.isalpha()) if len(labels) > 1 else frozenset()


def _number(plain: bytes) -> int:
    return int.from_bytes(blake2b(plain, digest_size=8).digest(), "little", signed=True)


def line_keys(text: str, own: frozenset[str] = frozenset(), title: str = "") -> tuple[int, int]:
    """A line as it is compared, as numbers: its letters, without the site's own name and the page's title; without its
    digits, as between sites, and with them, as between the pages of a site.  The same for lines without digits."""
    low = text.casefold()
    if title and len(title) > 3 and title in low:
        low = low.replace(title, "")
    if own and any(w in low for w in own):
        low = " ".join(w for w in low.split() if _SIGNS.sub("", w) not in own)
    if low.isascii():
        signs = low.encode().translate(None, _ASCII_SIGNS)
        plain = signs.translate(None, b"0123456789")
    else:
        text = _SIGNS.sub("", low)
        signs, plain = text.encode(), _DIGITS.sub("", text).encode()
    key = _number(plain)
    return key, key if plain == signs else _number(signs)


@lru_cache(300_000)
def phrase_key(text: str) -> int:
    return line_keys(text)[0]


def _label(text: str) -> str:
    """What stands before the colon of a line that lists three or more names; empty for other lines."""
    m = _LABEL.match(text)
    return m[1].strip().casefold() if m else ""


def _steps(text: str) -> list[str]:
    """The steps of a path; one where nothing parts them."""
    return [item(p) for p in _CRUMBS.split(text)] if any(c in text for c in "/»›>→:") else [item(text)]


def _titled(text: str) -> bool:
    """Like the title of a page: no sentence, table row, numbered item or measure."""
    return not (_HEADING.match(text) or _SENTENCE_END.search(text) or text.startswith("|") or _NUMBER_ITEM.match(text) or _MEASURE.search(text)) and len(text.split()) <= 14


class Known:
    """What the pages of a site and of all sites have in common.  items: the site's menu items; lines: keys of lines that
    stand on many of its pages; nav: menu items of many sites; home: first steps of their paths; phrases: brief lines of
    many sites; notices: keys of longer lines of many sites; asides: phrases after which titles of other pages follow;
    headings: section headings of pages in general; labels: what stands before the colon of lists of names."""

    def __init__(self, nav=(), home=(), phrases=(), notices=(), asides=(), headings=(), labels=()):
        self.nav, self.home, self.phrases = frozenset(nav), frozenset(home), frozenset(phrases)
        self.notices, self.asides, self.headings, self.labels = frozenset(notices), frozenset(asides), frozenset(headings), frozenset(labels)


def furniture(lines: list[Line], title: str | None, url: str | None, known: Known, items: frozenset[str] = frozenset(), repeated: frozenset[int] = frozenset(), pieces: bool = False) -> set[int]:
    """The numbers of the lines that are furniture."""
    shown = [x for x in lines if x.text]
    n = len(shown)
    low = [x.text.casefold() for x in shown]
    path = urlsplit(url or "").path.rstrip("/").rpartition("/")[2]
    slug = re.sub(r"-\d+$", "", path.rsplit(".", 1)[0].casefold())
    own, own_title = site_words(url), (title or "").strip().casefold()
    longest = max(len(own_title), 2 * len(slug)) + 12
    is_title = [len(t) <= longest and (bool(own_title) and t.strip("#= \t") == own_title or bool(slug) and _slug(t.lstrip("#=")) == slug) for t in low]
    menu = items | known.nav
    common, aside = [False] * n, [False] * n
    bad = [False] * n

    for k, x in enumerate(shown):
        t = low[k]
        if is_title[k] or t[0] == "|":
            continue
        key, exact = line_keys(x.text, own, own_title)
        aside[k] = key in known.asides
        common[k] = (len(t) > 90 or heading(x.text) not in known.headings) and (exact in repeated or (key in known.phrases if len(t.split()) <= BRIEF else key in known.notices))
        if _HEADING.match(x.text) and not common[k]:
            continue
        parts, crumbs = _parts(x.text), _steps(x.text)
        bare = not _STOPS.search(x.text)
        if x.linked and x.item and len(x.text.split()) <= 6:
            bad[k] = True
        elif common[k]:
            bad[k] = True
        elif parts and (len(parts) > 2 and (menu & set(parts)) or set(parts) <= menu):
            bad[k] = True
        elif parts and len(parts) > 3 and not any(_MEASURE.search(p) for p in parts):
            bad[k] = True
        elif len(crumbs) > 1 and crumbs[0] and not x.text.startswith(("|", ">")) and not _SENTENCE_END.search(x.text) and (crumbs[0] in known.home or crumbs[0] in menu and (len(crumbs) > 2 or crumbs[-1] == own_title or _slug(crumbs[-1]) == slug)):
            bad[k] = True
        elif bare and len(x.text.split()) > 1 and (seg := _segmented(x.text, known.phrases, menu))[0] > 1 and (seg[1] > 0.6 or seg[0] > 2 and seg[1] > 0.4 and x.text.isupper()):
            bad[k] = True
        elif _label(x.text) in known.labels:
            bad[k] = True
        elif x.text.count(",") >= 1 and len(t) < 110 and not _SENTENCE_END.search(t) and re.search(r"\d", t) and (name := set(re.findall(r"\w+", t.split(",")[0]))) and name <= own:
            bad[k] = True  # the site's own name and address

    # Menus down the page: runs of short lines, of which enough are known items.
    brief = [len(x.text) < 48 and not is_title[j] and _brief(item(x.text)) and not (_HEADING.match(x.text) or _MEASURE.search(x.text) or _NUMBER_ITEM.match(x.text)) for j, x in enumerate(shown)]
    k = 0
    while k < n:
        e = k
        while e < n and not bad[e] and brief[e]:
            e += 1
        if e > k:
            names = [item(shown[j].text) for j in range(k, e)]
            hits = [a in menu for a in names]
            # A section heading in plain text ends such a run.
            while e > k and heading(shown[e - 1].text) in known.headings and not (names[e - k - 1] in items and (e - k > 1 or 0 < k and e < n and bad[k - 1] and bad[e])):
                e -= 1
            size, good = e - k, sum(hits[: e - k])
            edge = k == 0 or e == n or bad[k - 1] or e < n and bad[e]
            among = size == 1 and names[0] in items and 0 < k and e < n and bad[k - 1] and bad[e] and item(shown[k - 1].text) in menu and item(shown[e].text) in menu
            if among or size >= 3 and good >= max(1, 0.3 * size) or size == 2 and good == 2 or size == 1 and good == 1 and edge and (names[0] in known.nav or pieces) and heading(shown[k].text) not in known.headings:
                for j in range(k, e):
                    bad[j] = True
        k = max(e, k + 1)

    # Sidebars: a phrase after which titles of other pages follow, and these titles.
    for k in range(n):
        if common[k] and aside[k]:
            bad[k] = True
            for j in range(k + 1, n):
                t = shown[j].text
                body = _MARK.sub("", t)
                if bad[j]:
                    if common[j] and not _brief(item(t)):
                        break
                    continue
                if is_title[j] or not _titled(t) or body == t and heading(t) in known.headings:
                    break
                bad[j] = True
        elif low[k].startswith("» ") and len(shown[k].text.split()) < 14 and not _SENTENCE_END.search(low[k]):
            bad[k] = True
            for j in (k - 1, k + 1):  # marks alternate within a sidebar
                if 0 <= j < n and not bad[j] and low[j].startswith("- ") and not _MEASURE.search(low[j]) and not _SENTENCE_END.search(low[j]) and (j == 0 or j > k or bad[j - 1]):
                    bad[j] = True

    # A piece can begin within a sidebar: titles that are neither the page's own nor a section's.
    if own_title or slug:
        for k, x in enumerate(shown):
            t = x.text
            if bad[k]:
                continue
            if is_title[k] or not _titled(t) or t.startswith(">") or len(t) > 100 or re.search(r"[=(`]", t) or not _MARK.sub("", t)[:1].isupper() or heading(_MARK.sub("", t)) in known.headings:
                break
            bad[k] = True
    return {x.number for x, b in zip(shown, bad) if b}


#: Lines of up to so many words are phrases, longer ones notices.
BRIEF = 4


def votes(lines: list[Line], title: str | None, url: str | None) -> set[tuple[str, str]]:
    """(kind, name) of what a page says about menu items (m), first steps of paths (c), headings (h), its lines (p and n,
    brief and longer; r with their digits, if they have any), labels (l), and the lines after which titles follow (f)."""
    own, own_title = site_words(url), (title or "").strip().casefold()
    shown = [x for x in lines if x.text]
    out = {("m", x) for x in menu_items(lines)}
    for k, x in enumerate(shown):
        if x.text[0] == "|":
            continue
        if _HEADING.match(x.text) and len(x.text) < 80:
            out.add(("h", heading(x.text)))
        words = len(x.text.split())
        plain, exact = line_keys(x.text, own, own_title)
        key = str(plain)
        out.add(("n" if words > BRIEF else "p", key))
        if exact != plain:
            out.add(("r", str(exact)))
        if label := _label(x.text):
            out.add(("l", label))
        if words <= 2 * BRIEF and not _SENTENCE_END.search(x.text):
            after = shown[k + 1 : k + 3]
            if len(after) == 2 and all(_titled(y.text) and len(y.text.split()) > 1 and "|" not in y.text and not y.linked for y in after) and any(len(y.text.split()) > 2 for y in after):
                out.add(("f", key))
        crumbs = _steps(x.text)
        if len(crumbs) > 2 and all(_brief(q) for q in crumbs[:-1]) and not x.text.startswith(">"):
            out.add(("c", crumbs[0]))
    return out


def is_html(document_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(document_type)) == "html", F.lit(False))


#: A menu item or line is the site's own from so many of its pages on, and from this share of them on.
MIN_PAGES, MIN_SHARE, MIN_LINE_PAGES, MIN_LINE_SHARE = 2, 0.01, 4, 0.03
#: What sites share stands on so many of them, and on this share of them (so there is little of it); first steps of
#: paths on a larger share.
MIN_SITES, SITE_SHARE, HOME_SHARE = 3, 0.02, 0.1
#: A heading, or a phrase before titles, is a common one from this share of all pages on, and so many pages; a phrase
#: before titles has them on this part of its pages.
PAGE_SHARE, PAGES, BEFORE = 0.0005, 3, 0.3
#: Items and lines of sites are broadcast up to so many bytes; beyond that their join is shuffled, each site in PARTS.
MAX_BROADCAST_BYTES, PARTS = 64 << 20, 16


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"site": [], "page": [], "kind": [], "name": []}
        for site, page, content, title, url in zip(*(b.column(c).to_pylist() for c in ("site", "page", "content", "title", "url"))):
            for kind, name in sorted(votes(source_lines(content.replace("\r", " ")), title, url)):
                for c, v in zip(out, (site, page, kind, name)):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64() if c == "page" else pa.string()) for c in out]))


def _known(counted: DataFrame, pages: int, sites: int) -> Known:
    """What sites have in common, from counted (site, kind, name, n pages, own: enough of the site's pages)."""
    named = counted.where("site <> ''")
    among = named.where("kind in ('c', 'p', 'n', 'l') or kind = 'm' and own").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("sites"))
    share = F.greatest(F.lit(MIN_SITES), F.lit(sites) * F.when(F.col("kind") == "c", HOME_SHARE).otherwise(SITE_SHARE))
    got: dict[str, set[str]] = {k: set() for k in "cpnlmhf"}
    for r in among.where(F.col("sites") >= share).select("kind", "name").toLocalIterator():
        got[r["kind"]].add(r["name"])
    # Numbers of pages, summed over the sites.
    least = max(PAGES, PAGE_SHARE * pages)
    total = counted.where("kind in ('h', 'f', 'p', 'n')").groupBy("name").agg(*(F.sum(F.when(F.col("kind").isin(*k), F.col("n"))).alias(k) for k in ("h", "f", "pn")))
    for r in total.where((F.col("h") >= least) | (F.col("f") >= least) & (F.col("f") >= BEFORE * F.col("pn"))).toLocalIterator():
        got["h" if (r["h"] or 0) >= least else "f"].add(r["name"])
    return Known(got["m"] - got["h"], got["c"], map(int, got["p"]), map(int, got["n"]), map(int, got["f"]), got["h"], got["l"])


def mark_furniture(df: DataFrame, id_col: str = "request_id", text_col: str = "content") -> DataFrame:
    """(id, content, lines): each web page, or piece of one, once, with the numbers of its furniture lines.

    Line numbers start at 1 and count the pieces between \\n.  Only rows whose document_type is html count; a null id
    or content gives no row, an empty one no lines.  A null url leaves the site unknown: what sites share still counts.
    Repeated rows of an id count once.  Everything is counted over all pages by aggregation; the rows of a site are never
    gathered in one place.  With fewer than three sites only what a site repeats itself is known."""
    spark = df.sparkSession
    rows = df.where(is_html(F.col("document_type")) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"), "title", "url", "total_chunks").dropDuplicates(["id"])
    link = F.lower(F.trim(F.regexp_replace("url", "#.*$", "")))
    rows = cut(rows.withColumns({"site": F.coalesce(site_key(link), F.lit("")), "page": F.xxhash64(F.coalesce(page_key(link), F.col("id").cast("string")))}), "p1-pages")
    said = rows.select("site", "page", "content", "title", "url").mapInArrow(_votes, "site string, page bigint, kind string, name string").where("kind not in ('m', 'r', 'c', 'l') or site <> ''").distinct()
    counted = said.groupBy("site", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    pages = cut(rows.groupBy("site").agg(F.count_distinct("page").alias("pages")), "p1-pages-of-sites")
    least = F.when(F.col("kind") == "m", F.greatest(F.lit(MIN_PAGES), F.col("pages") * MIN_SHARE)).otherwise(F.greatest(F.lit(MIN_LINE_PAGES), F.col("pages") * MIN_LINE_SHARE))
    # A site's number of pages is 16 bytes or so; the sites are at most as many as pages, so their size is checked.
    counted = cut(counted.join(small(pages, pages.count(), 2_000_000), "site").select("site", "kind", "name", "n", (F.col("n") >= least).alias("own")).where("own or kind not in ('m', 'r')"), "p1-counts")
    size = pages.agg(F.sum("pages").alias("pages"), F.count_if(F.col("site") != "").alias("sites")).first()
    shipped = spark.sparkContext.broadcast(_known(counted, size["pages"] or 0, size["sites"]))  # little, by the shares
    mine = counted.where("own and site <> '' and kind in ('m', 'r', 'p', 'n')")
    # A page votes for its own lines only, so names above a share of a site's pages are few.
    sites = mine.groupBy("site").agg(F.collect_set(F.when(F.col("kind") == "m", F.col("name"))).alias("items"), F.collect_set(F.when(F.col("kind") != "m", F.col("name").cast("bigint"))).alias("repeated"))
    sites = cut(sites, "p1-sites")
    weight = sites.agg(F.sum(100 + 40 * F.size("items") + 8 * F.size("repeated"))).first()[0] or 0
    if weight <= MAX_BROADCAST_BYTES:
        joined = rows.join(F.broadcast(sites), "site", "left")
    else:
        part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
        joined = rows.withColumn("part", part).join(sites.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>"))), ["site", "part"], "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for content, title, url, chunks, items, again in zip(*(b.column(c).to_pylist() for c in ("content", "title", "url", "total_chunks", "items", "repeated"))):
                lines = source_lines(content.replace("\r", " "))
                marks.append(sorted(furniture(lines, title, url, shipped.value, frozenset(items or ()), frozenset(again or ()), (chunks or 1) > 1)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("content"), pa.array(marks, pa.list_(pa.int32()))], ["id", "content", "lines"])

    kind = df.schema[id_col].dataType.simpleString()
    return joined.select("id", "content", "title", "url", "total_chunks", "items", "repeated").mapInArrow(judge, f"id {kind}, content string, lines array<int>").withColumnsRenamed({"id": id_col, "content": text_col})


def furniture_lines(df: DataFrame, id_col: str = "request_id", text_col: str = "content") -> DataFrame:
    """(id, line_no) of each furniture line."""
    return mark_furniture(df, id_col, text_col).select(id_col, F.explode("lines").alias("line_no"))


def main_body(df: DataFrame, id_col: str = "request_id", text_col: str = "content") -> DataFrame:
    """(id, body, removed_lines): the rendered text of each page without its furniture lines."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for content, gone in zip(b.column(text_col).to_pylist(), b.column("lines").to_pylist()):
                cutout = set(gone)
                texts.append(render("\n".join(x for k, x in enumerate(content.split("\n"), 1) if k not in cutout)).strip())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string()), pa.array([len(g) for g in b.column("lines").to_pylist()], pa.int32())], [id_col, "body", "removed_lines"])

    kind = df.schema[id_col].dataType.simpleString()
    return mark_furniture(df, id_col, text_col).mapInArrow(body, f"{id_col} {kind}, body string, removed_lines int")
