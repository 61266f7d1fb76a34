"""T4: HTML to text, as native Spark expressions.

Semantics (the intended cleaner of the HTML mail sources): a null or blank
value becomes ``''``; a value with no tag is only stripped; otherwise the text
nodes are taken in document order -- comments, doctype, script and style
content dropped -- each is entity-decoded and stripped, empty ones are dropped,
and the rest are joined with one space.

The document is split on the markup regex itself, so no sentinel character is
needed. Entities of the fixed list below are decoded with ``replace``. A row that
holds any other character reference is cut at its references; each is decoded by
the rules of HTML 5 (as ``html.unescape`` does): names by a lookup in the standard
table, the longest known name where the semicolon is missing, numbers as code
points with the standard's replacements. All of it are built-in expressions.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusframe.functions.text import WS_CHARS, _col, is_blank, strip_ws

# Markup that carries no text: comments, doctype, script and style elements
# (an unclosed one runs to the end of the document), then any other tag.
# A tag starts with '<' and a letter, '/', '!' or '?' (as in html.parser), so
# '1 < 2' stays text.
MARKUP_PATTERN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<!doctype[^>]*>"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|</?[a-z][^>]*>"
    r"|<[!?][^>]*>"
)
# The reference's "is there any tag" test.
ANY_TAG_PATTERN = r"<[^>]+>"

# Named entities decoded natively, with their characters;
# '&amp;' is decoded last so that '&amp;lt;' yields '&lt;'.
NATIVE_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", "\xa0"),
    ("&copy;", "\xa9"),
    ("&reg;", "\xae"),
    ("&middot;", "\xb7"),
    ("&amp;", "&"),
)
_NATIVE_NAMES = "|".join(re.escape(e[1:-1]) for e, _ in NATIVE_ENTITIES)
# Any character reference that the native chain does not decode exactly.
OTHER_ENTITY_PATTERN = r"&(?!(?:" + _NATIVE_NAMES + r");)[#A-Za-z]"


def decode_native_entities(c: Column) -> Column:
    for entity, char in NATIVE_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


# A character reference, whole.
REFERENCE_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that count without a semicolon, also before other letters; longest first.
_BARE_NAMES = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
# Numbers 128 to 159 mean the characters of this code page, where it has them.
_CODE_PAGE = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))
_REPLACEMENT = "\ufffd"


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _named(name: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # folded to one literal
    start = F.regexp_extract(name, _BARE_NAMES, 0)
    shorter = F.when(start != "", F.concat(F.try_element_at(table, start), F.substr(name, F.length(start) + 1)))
    return F.coalesce(F.try_element_at(table, name), shorter, F.concat(F.lit("&"), name))


def _numbered(name: Column) -> Column:
    digits = F.ltrim(F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+)", 1), F.lit("0"))
    number = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(
        F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    )

    def char(n: Column) -> Column:
        unused = n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit(_REPLACEMENT))
            .when(n.between(0x80, 0x9F), F.substr(F.lit(_CODE_PAGE), (n - 0x7F).cast("int"), F.lit(1)))
            .when(unused, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return _bind(F.coalesce(number, F.lit(0)), char)


def unescape(c: Column) -> Column:
    """Every character reference of a text decoded, in one pass from the left."""

    def decoded(reference: Column) -> Column:
        name = F.substr(reference, F.lit(2))
        return F.when(name.startswith("#"), _numbered(name)).otherwise(_named(name))

    def joined(m: Column) -> Column:
        pieces = F.transform(m["between"], lambda t, i: F.concat(t, F.coalesce(decoded(F.get(m["references"], i)), F.lit(""))))
        return F.array_join(pieces, "")

    cut = F.struct(F.regexp_extract_all(c, F.lit(REFERENCE_PATTERN), F.lit(0)).alias("references"), F.split(c, REFERENCE_PATTERN, -1).alias("between"))
    return F.when(c.contains("&"), _bind(cut, joined)).otherwise(c)


def html_to_text(c) -> Column:
    c = _col(c)
    joined = lambda parts: F.array_join(F.filter(parts, lambda p: p != ""), " ")
    strip = lambda p: F.btrim(p, F.lit(WS_CHARS))
    parts = F.split(c, MARKUP_PATTERN)
    return (
        F.when(is_blank(c), F.lit(""))
        .when(~c.rlike(ANY_TAG_PATTERN), strip_ws(c))
        .when(c.rlike(OTHER_ENTITY_PATTERN), joined(F.transform(parts, lambda p: strip(unescape(p)))))
        .otherwise(joined(F.transform(parts, lambda p: strip(decode_native_entities(p)))))
    )
