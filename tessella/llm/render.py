"""Layout-aware rendering of markup and browser text.

A tree builder on the standard tokenizer closes what HTML lets authors leave open (implied end tags), drops what
isn't shown (visibility rules), and emits all visible text: blocks with their spacing, list items with their marks,
table cells aligned in columns.  Every piece of text keeps the number of the source line it stands on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessella.functions.markup import BLOCK, Builder, Element

# Element kinds as HTML defines them.
UNSEEN = frozenset("script style template noscript head title meta datalist iframe object svg canvas select option".split())
SPACED = frozenset("p blockquote h1 h2 h3 h4 h5 h6 ul ol table pre dl figure article section".split())
CELLS = frozenset(("td", "th"))
TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node(Element):
    """An element whose children are nodes, or (line, text)."""

    @property
    def seen(self) -> bool:
        a = self.attrs
        return not (self.tag in UNSEEN or "hidden" in a or (a.get("aria-hidden") or "") == "true" or _HIDING.search(a.get("style") or "") or (self.tag == "input"))


class TreeBuilder(Builder):
    """Notes the source line of every text."""

    element = Node

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append((self.getpos()[0], data))


def tree(markup: str) -> Node:
    b = TreeBuilder()
    b.feed(markup)
    b.close()
    return b.root


@dataclass
class Line:
    """A source line as it is shown: its visible text, whether all of it is in links, whether it is an item of a list
    made by markup."""

    number: int
    text: str
    linked: bool = False
    item: bool = False


def source_lines(content: str) -> list[Line]:
    """The visible text of each source line (pieces between \\n), numbered from 1."""
    raw = content.split("\n")
    if "<" not in content or not TAG.search(content):
        return [Line(k, x.strip()) for k, x in enumerate(raw, 1)]
    texts: list[list[tuple[str, bool, bool]]] = [[] for _ in raw]

    def walk(node: Node, linked: bool, item: bool) -> None:
        for c in node.children:
            if isinstance(c, Node):
                if c.tag in BLOCK or c.tag in CELLS or c.tag == "br":
                    pass
                if c.seen:
                    walk(c, linked or c.tag == "a", item or c.tag == "li")
            else:
                for k, part in enumerate(c[1].split("\n")):
                    if part.strip() and c[0] - 1 + k < len(texts):
                        texts[c[0] - 1 + k].append((part, linked, item))

    walk(tree(content), False, False)
    return [Line(k, " ".join(p.strip() for p, _, _ in x), bool(x) and all(a for _, a, _ in x), bool(x) and all(i for _, _, i in x)) for k, x in enumerate(texts, 1)]


def render(content: str | None) -> str:
    """All visible text, laid out: blocks on lines of their own, a blank line around paragraphs, headings, lists and
    tables, `- ` or `1. ` before list items by depth, table cells padded to the width of their column."""
    if not content:
        return ""
    content = content.replace("\r\n", "\n").replace("\r", "\n")
    if "<" not in content or not TAG.search(content):
        return content
    out: list[str] = [""]

    def fresh(blank: bool = False) -> None:
        if out[-1].strip():
            out.append("")
        if blank and len(out) > 1 and out[-2] != "":
            out.append("")

    def table(node: Node) -> list[str]:
        rows: list[list[str]] = []

        def find(n: Node) -> None:
            for c in n.children:
                if isinstance(c, Node) and c.seen:
                    if c.tag == "tr":
                        rows.append([inline(x) for x in c.children if isinstance(x, Node) and x.tag in CELLS and x.seen])
                    elif c.tag != "table":
                        find(c)

        find(node)
        widths = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
        return ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows]

    def inline(node: Node) -> str:
        return " ".join(" ".join(c[1] if not isinstance(c, Node) else inline(c) if c.seen else "" for c in node.children).split())

    def walk(node: Node, depth: int, order: list[int] | None, pre: bool) -> None:
        for c in node.children:
            if not isinstance(c, Node):
                if pre or node.tag == "body":  # browser text keeps its line breaks
                    parts = c[1].split("\n")
                    out[-1] += parts[0]
                    out.extend(parts[1:])
                else:
                    words = " ".join(c[1].split())
                    if words:
                        out[-1] += (" " if out[-1].strip() and (c[1][:1].isspace() or out[-1][-1:].isspace()) and not out[-1].endswith(" ") else "") + words + (" " if c[1][-1:].isspace() else "")
                continue
            if not c.seen:
                continue
            if c.tag == "br":
                out.append("")
            elif c.tag == "table":
                fresh(True)
                out[-1:] = table(c) or [""]
                fresh(True)
            elif c.tag == "li":
                fresh()
                if order is not None:
                    order[0] += 1
                out[-1] = "  " * max(0, depth - 1) + (f"{order[0]}. " if order is not None else "- ")
                walk(c, depth, None, pre)
            elif c.tag in BLOCK:
                fresh(c.tag in SPACED and not (c.tag in ("ul", "ol") and depth))
                walk(c, depth + (c.tag in ("ul", "ol")), [0] if c.tag == "ol" else None, pre or c.tag == "pre")
                fresh(c.tag in SPACED and not (c.tag in ("ul", "ol") and depth))
            else:
                walk(c, depth, order, pre)

    walk(tree(content), 0, None, False)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in out)).strip("\n")
