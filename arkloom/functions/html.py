"""Text and anchors of HTML pages."""

from __future__ import annotations

from html import unescape
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities of HTML 4, and "apos".
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_html(html: Column | str) -> Column:
    """Struct of a page's text and its length in characters, by regular expressions.

    Scripts, styles, comments and the head go with what they hold, then all tags;
    runs of white space become one blank, and entities are resolved: those of ENTITIES
    with their semicolon, numeric ones with or without.
    """
    t = F.regexp_replace(_col(html), r"(?is)<(script|style|head|title)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))
    t = F.when(t.contains("&"), resolved(t)).otherwise(t)
    return F.struct(t.alias("text"), F.length(t).alias("text_len"))


NUMERIC = r"\A#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));?"
NAMED = r"\A([A-Za-z][A-Za-z0-9]*);"


def resolved(text: Column) -> Column:
    """The text with its entities resolved in one pass; what is none stays."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(p: Column) -> Column:
        part = lambda i: F.regexp_extract(p, NUMERIC, i)
        code = F.coalesce(part(1).try_cast("int"), F.conv(F.when(part(2) != "", part(2)), 16, 10).try_cast("int"))
        fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.element_at(known, F.regexp_extract(p, NAMED, 1))
        return (
            F.when(fine, F.concat(char, F.regexp_replace(p, NUMERIC, "")))
            .when(named.isNotNull(), F.concat(named, F.regexp_replace(p, NAMED, "")))
            .otherwise(F.concat(F.lit("&"), p))
        )

    parts = F.split(text, "&")
    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))


class _Text(HTMLParser):
    _hidden = {"script", "style", "head", "title", "noscript", "template"}
    _inline = {"a", "b", "i", "u", "em", "strong", "span", "font", "small", "big", "sub", "sup", "code", "tt", "abbr", "q", "s"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self._hidden:
            self.depth += 1
        elif tag not in self._inline:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self._hidden:
            self.depth = max(0, self.depth - 1)
        elif tag not in self._inline:
            self.parts.append(" ")
        if tag == "head":
            self.depth = 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def page_text(html: str | None) -> str | None:
    """Text of a page's body with entities resolved, unterminated ones too."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return unescape(" ".join(x for x in "".join(p.parts).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x))


def strip_html_robust(html: Column | str) -> Column:
    """As ``strip_html``, by a parser in Arrow batches; for pages that regular expressions misread."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(page_text)

    t = text(_col(html))
    return F.struct(t.alias("text"), F.length(t).alias("text_len"))


#: Fixed value: how a link is recognised.
ANCHOR = r'<a[\s]+href[\s]*=[\s]*"[^>]*>(.*?)</a>'


def anchor_texts(html: Column | str) -> Column:
    """Texts of links whose first attribute is a quoted href, on one line; null for pages under 15 characters."""
    found = F.regexp_extract_all(_col(html), F.lit(ANCHOR), F.lit(1))
    return F.when(F.length(_col(html)) >= 15, found)
