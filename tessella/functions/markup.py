"""A small tree of HTML on the standard tokenizer, with implied end tags, and extraction of its sections and tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Element kinds as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption""".split())
DROPPED = frozenset("script style noscript nav footer header aside form button iframe svg template".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list = field(default_factory=list)


class Builder(HTMLParser):
    """Builds the tree of `element`s; unknown end tags are ignored, open elements end with the text."""

    element = Element

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.element("body")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, barrier = CLOSES.get(tag, ({"p"}, {"body", "td", "th", "li", "div"}) if tag in BLOCK else ((), ()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in barrier:
                break
            if self.open[k].tag in ends:
                del self.open[k:]
        e = self.element(tag, dict(attrs))
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(markup: str | None) -> Element:
    b = Builder()
    b.feed(markup or "")
    b.close()
    return b.root


def find_all(e: Element, *tags: str) -> list[Element]:
    out = []
    for c in e.children:
        if isinstance(c, Element):
            if c.tag in tags:
                out.append(c)
            out += find_all(c, *tags)
    return out


def text_of(e: Element, skip: frozenset[str] = DROPPED) -> str:
    parts: list[str] = []

    def walk(x: Element) -> None:
        for c in x.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag not in skip:
                parts.append(" " if c.tag in BLOCK or c.tag in ("br", "td", "th") else "")
                walk(c)
                parts.append(" " if c.tag in BLOCK or c.tag in ("td", "th") else "")

    walk(e)
    return " ".join("".join(parts).split())


def meta(markup: str | None) -> tuple[str | None, str | None]:
    """(title, description); the description from the meta tags description, og:description, twitter:description."""
    root = parse(markup)
    titles = find_all(root, "title")
    named = {(m.attrs.get("name") or m.attrs.get("property") or "").lower(): (m.attrs.get("content") or "").strip() for m in find_all(root, "meta")}
    description = next((named[k] for k in ("description", "og:description", "twitter:description") if named.get(k)), None)
    return (text_of(titles[0]) or None if titles else None), description


def links(markup: str | None) -> list[str]:
    return [a.attrs["href"] for a in find_all(parse(markup), "a") if a.attrs.get("href")]


def sections(markup: str | None, skip: frozenset[str] = frozenset()) -> list[tuple]:
    """(section, subsection, section_index, subsection_index, anchor, kind, text) in document order.  What comes before
    the first h2 is `Lead`; skipped sections (lower-case names) take their subsections along; a page without headings
    is all lead.  Tables are blocks of their own, one line a row, cells parted by bars."""
    root = parse(markup)
    body = next(iter(find_all(root, "article") or find_all(root, "main") or find_all(root, "body")), root)
    out: list[tuple] = []
    at = ["Lead", None, 0, 0, None]
    hidden = False

    def table(e: Element) -> str:
        rows = [" | ".join(text_of(c) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")) for r in find_all(e, "tr")]
        return "\n".join(r for r in rows if r)

    def walk(e: Element) -> None:
        nonlocal hidden
        for c in e.children:
            if isinstance(c, str):  # text outside of any block
                if not hidden:
                    out.extend((*at, "text", t) for line in c.split("\n") if (t := " ".join(line.split())))
                continue
            if c.tag in DROPPED or c.tag in ("head", "title") or _dropped(c):
                continue
            name = text_of(c) if c.tag in ("h2", "h3", "h4") else ""
            if c.tag == "h2" and name:
                hidden = name.lower() in skip
                at[:] = [name, None, at[2] + 1, 0, c.attrs.get("id")]
            elif c.tag in ("h3", "h4") and name:
                at[1], at[3], at[4] = name, at[3] + (c.tag == "h3"), c.attrs.get("id") or at[4]
            elif c.tag == "table":
                if not hidden and (t := table(c)):
                    out.append((*at, "table", t))
            elif c.tag in ("p", "ul", "ol", "blockquote", "pre", "dl", "h1"):
                if not hidden and (t := text_of(c)):
                    out.append((*at, "text", t))
            else:
                walk(c)

    walk(body)
    return out


# Classes of parts that aren't a page's text.
DROPPED_CLASSES = frozenset("sidebar toc infobox reference references mw-editsection".split())


def _dropped(e: Element) -> bool:
    return not DROPPED_CLASSES.isdisjoint((e.attrs.get("class") or "").split())


def tables(markup: str | None) -> list[tuple[int, list[str], list[list[str]]]]:
    """(number from 1, headers, rows) of the tables that stand in no other table.  Headers are the th cells of thead, else
    of the first row that has any, else the first row's cells; a first row equal to them is no row; empty cells drop out."""

    def outer(e: Element) -> list[Element]:
        out = []
        for c in e.children:
            if isinstance(c, Element) and not _dropped(c):
                out += [c] if c.tag == "table" else outer(c)
        return out

    got = []
    for k, t in enumerate(outer(parse(markup)), 1):
        lines = [[(c.tag, text_of(c)) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in find_all(t, "tr")]
        head = next(iter(find_all(t, "thead")), None)
        headers = [x for c in (find_all(head, "th") if head else []) if (x := text_of(c))]
        if not headers:
            named = next((r for r in lines if any(tag == "th" for tag, _ in r)), None)
            headers = [x for tag, x in named if tag == "th" and x] if named else [x for _, x in (lines[0] if lines else []) if x]
        rows = [y for r in lines if (y := [x for _, x in r if x])]
        got.append((k, headers, rows[1:] if rows and headers and rows[0] == headers else rows))
    return got


def table_chunks(markup: str | None, per: int = 12) -> list[tuple[int, int, int, str]]:
    """(table, chunk from 0, chunks, text): rows of a page's tables, `per` at a time under a line of the column names."""
    out = []
    for k, headers, rows in tables(markup):
        head = [f"Columns: {' | '.join(headers)}"] if headers else []
        parts = [rows[s : s + per] for s in range(0, len(rows), per)]
        out += [(k, i, len(parts), "\n".join(head + [" | ".join(r) for r in p])) for i, p in enumerate(parts)]
    return out


def infobox(markup: str | None) -> list[tuple[str, str]]:
    """(label, value) rows of the first table of class infobox."""
    box = next((t for t in find_all(parse(markup), "table") if "infobox" in (t.attrs.get("class") or "").split()), None)
    rows = [[text_of(c) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in find_all(box, "tr")] if box else []
    return [(r[0], r[1]) for r in rows if len(r) == 2 and r[0] and r[1]]
