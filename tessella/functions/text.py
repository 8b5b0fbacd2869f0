"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """Null for null, empty and blank strings: missing values are treated alike."""
    return F.when(F.trim(c) != "", c)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*(present(c) for c in cols))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def host(url: Column) -> Column:
    """Host in lower case, without user and port; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@|:[0-9]*$", "")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen; `section` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "section").otherwise(F.coalesce(s, F.lit("section")))


def normalise(c: Column) -> Column:
    """Typographic quotes made plain, no-break spaces and runs of blanks made one space, at most one blank line, single
    line breaks made spaces, bracketed numbers dropped, trimmed."""
    c = F.translate(c, "“”‘’ ", "\"\"'' ")
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[\t ]+", " ")
    c = F.regexp_replace(c, "\n{2,}", "\u0001")
    c = F.regexp_replace(F.regexp_replace(c, " ?\n ?", " "), "\u0001", "\n\n")
    return F.trim(F.regexp_replace(c, r"\[[0-9]+\]", ""))


def clean_wikitext(c: Column) -> Column:
    """Plain text of wikitext: without comments, references, tables, templates (nested ones too), file and category
    links, magic words; links become their labels, bold and italics marks go."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<ref[^>/]*/>", r"(?is)<ref.*?</ref>", r"(?s)\{\|.*?\|\}", r"\{\{[^{}]*\}\}", r"\{\{[^{}]*\}\}", r"\{\{[^{}]*\}\}", r"(?i)\[\[(file|image|category|datei|kategorie)\s*:[^\]]*\]\]", r"__[A-Z]+__"):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(c, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    c = F.regexp_replace(c, r"\[https?://\S+ ([^\]]*)\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "'{2,}", ""), "\n{3,}", "\n\n"))


def payload_text(payload: Column, longer_than: int = 50) -> Column:
    """The text of a payload map: the first of the fields text, content, document_text, chunk_text that isn't empty, else
    the first value of more than longer_than characters."""
    named = F.coalesce(*(F.when(payload[k] != "", payload[k]) for k in ("text", "content", "document_text", "chunk_text")))
    return F.coalesce(named, F.get(F.filter(F.map_values(payload), lambda v: F.length(v) > longer_than), F.lit(0)))


def strip_last_sources(c: Column) -> Column:
    """Without a block of sources at the end: a line `Sources:` of its own after a line break and all that follows, and
    without blanks at the end."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)\r?\n(?:<sources>Sources</sources>|Sources|sources):\s*\r?\n.*$", ""), r"\s+$", "")


# Entities that texts use most.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def unescape(c: Column) -> Column:
    """The usual HTML entities as characters; & last, so that nothing is undone twice."""
    for name, value in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def strip_sources(c: Column) -> Column:
    """Cut the answer's list of sources: everything from a line that begins with `Sources:` on."""
    return F.regexp_replace(c, r"(?s)(^|\n+)\s*Sources:.*$", "")


def strip_fence(c: Column) -> Column:
    """Without a code fence around the whole text."""
    return F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1")


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def words(c: Column) -> Column:
    """Number of words parted by white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^ \t\n\r]+")), F.lit(0))


def tokens(c: Column) -> Column:
    """A token for each four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def uuid5(namespace_hex: Column, name: Column) -> Column:
    """Name-based UUID (version 5) from the namespace's 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(namespace_hex), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substring(variant, -1, 1), F.substring(h, 18, 3)), F.substring(h, 21, 12))


NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the URL namespace of RFC 4122


def point_id(url: Column, position: Column) -> Column:
    """The id of the chunk at a position of a page: a UUID of the position within the page's own UUID."""
    return uuid5(F.regexp_replace(uuid5(F.lit(NAMESPACE_URL), url), "-", ""), position.cast("string"))


def source_entries(c: Column) -> Column:
    """The entries `[1] ...`, `[2, 3] ...` of a list of sources."""
    return F.regexp_extract_all(c, F.lit(r"(\[[0-9]+(?:, ?[0-9]+)*\][^\[]*)"), F.lit(1))


def cited(c: Column) -> Column:
    """The distinct context numbers an answer cites, ascending: `[1]`, `[1, 3]`; other brackets don't count."""
    groups = F.regexp_extract_all(c, F.lit(r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("int"))))
