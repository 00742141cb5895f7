"""Text helpers as column expressions.

They follow Unicode rules throughout: regular expressions that use ``\\s``, ``\\d``, ``\\w`` or ``\\b``
carry the ``(?U)`` flag, because Java's classes are ASCII-only without it.
"""

import re
import sys
import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and decimal digits of all scripts, from the Unicode tables.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_FOREIGN_DIGITS = "".join(_DIGITS)
_ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in _DIGITS)

_TAG = r"<[^>]+>"

#: Longer than any text or array.
MAX_LENGTH = 1 << 30


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it.

    Within one expression Spark often repeats what is written twice. The value is made the only element
    of an array here, over which ``use`` is mapped.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find(text: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches, else NULL. The group must not match empty text."""
    def one(pattern):
        return bind(F.regexp_extract(text, pattern, 1), lambda found: F.when(found != "", found))
    return F.coalesce(*[one(p) for p in patterns])


def find_or_empty(text: Column, *patterns: str) -> Column:
    """As :func:`find`, for a group that may match empty text: '' then means found, NULL not found."""
    def one(pattern):
        return bind(F.regexp_extract(text, pattern, 0),
                    lambda whole: F.when(whole != "", F.regexp_extract(whole, pattern, 1)))
    return F.coalesce(*[one(p) for p in patterns])


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace (``trim`` alone removes blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_tags(text: Column, replacement: str = "") -> Column:
    return F.regexp_replace(text, _TAG, replacement)


def contains_any(text: Column, words) -> Column:
    """True if the text contains one of the words. False, never NULL, when there are no words."""
    condition = F.lit(False)
    for word in words:
        condition = condition | text.contains(word)
    return condition


def to_int(text: Column) -> Column:
    """A number with thousands commas, in digits of any script, as bigint; NULL if it is none."""
    digits = F.translate(F.replace(text, F.lit(","), F.lit("")), _FOREIGN_DIGITS, _ASCII_DIGITS)
    return digits.try_cast("bigint")


def decimal_to_int(text: Column) -> Column:
    """A decimal number cut off at the point, as bigint; NULL if it is none.

    The pattern comes first, as a cast would also take the suffixes of Java's numbers: '5000d' is none.
    """
    number = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(number, text.try_cast("double").try_cast("bigint"))


def whole_json(text: Column, kind: str) -> Column:
    """JSON text as a value of this type; NULL unless the whole text is one such value.

    Read alone, a value would be taken even with other text behind it, since Spark's parser stops at its end. So
    the text is read as the one element of a list and as the one field of an object: what closes the list early
    does not close the object, and the other way round.
    """
    def both(whole):
        return F.struct(
            F.from_json(F.concat(F.lit("["), whole, F.lit("]")), f"array<{kind}>").alias("listed"),
            F.from_json(F.concat(F.lit('{"v":'), whole, F.lit("}")), f"v {kind}, broken string",
                        {"columnNameOfCorruptRecord": "broken"}).alias("field"))

    # The text is made, and each form of it parsed, once.
    return bind(bind(text, both), lambda r: F.when(
        (F.size(r["listed"]) == 1) & r["field"]["broken"].isNull() & r["field"]["v"].isNotNull(), r["listed"][0]))


def price_digits(text: Column) -> Column:
    """All digits of a price text as one bigint: 'PKR 1,20,000' is 120000, and 'Rs. 5.00' is 500."""
    return to_int(F.nullif(F.regexp_replace(text, r"(?U)[^\d]", ""), F.lit("")))


def slug(url: Column) -> Column:
    """Stable key of a product page: the address without its host, other characters as single dashes.

    Letters and numbers of all scripts are kept, and the whole address counts.
    """
    path = F.rtrim(F.regexp_replace(url, r"https?://[^/]+/", ""), F.lit("/"))
    dashed = F.regexp_replace(path, r"[^\p{L}\p{N}_-]", "-")
    return F.regexp_replace(dashed, "-{2,}", "-")


def part_key(source: Column, source_id: Column) -> Column:
    """Surrogate key of a natural key. 128 bits, so that billions of rows do not collide."""
    return F.md5(F.concat_ws("/", source, source_id))


def packed_key(key: Column) -> Column:
    """A key as it goes through shuffles: one of :func:`part_key` as the 16 bytes that its letters stand for, which keeps
    the order; any other text behind 17 zeros, so that none is taken for another."""
    return (F.when(key.rlike(r"\A[0-9a-f]{32}\z"), F.unhex(key))
            .otherwise(F.concat(F.lit(bytes(17)), key.cast("binary"))))


def unpacked_key(packed: Column) -> Column:
    """The inverse of :func:`packed_key`."""
    return (F.when(F.length(packed) == 16, F.lower(F.hex(packed)))
            .otherwise(F.substring(packed, 18, MAX_LENGTH).cast("string")))


def absolute_url(base: str, href: Column) -> Column:
    """An address as printed on a page of ``base``, made absolute."""
    return (F.when(F.coalesce(href, F.lit("")) == "", "")
            .when(href.startswith("http"), href)
            .when(href.startswith("/"), F.concat(F.lit(base), href))
            .otherwise(F.concat(F.lit(base + "/"), href)))


def name_matches(name: Column, query: str) -> Column:
    """Search as SQL LIKE '%query%' does where only ASCII letters fold case.

    ``%`` and ``_`` in the query stay wildcards and nothing escapes them.
    """
    wild = {"%": ".*", "_": "."}
    pattern = "".join(wild.get(c) or (re.escape(c) if c.isascii() else c) for c in query)
    return name.rlike(f"(?is){pattern}")


# An entity: a number, a number in base 16, or a name, which may lack its semicolon.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_COMMON = ("amp;", "quot;", "lt;", "gt;", "nbsp;")
_NAMES = {**{name: html5[name] for name in _COMMON}, **html5}
#: Names that also count without a semicolon, and then in front of any other text; the longest one wins.
_OPEN_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
_REPLACEMENT = "\ufffd"
#: Numbers that browsers read as bytes of Windows-1252, as far as it has a character for them.
_BYTES = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _character(number: Column) -> Column:
    """The character of a code point. The byte order mark in front is the one the decoder takes away."""
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(number), 8, "0"))), "UTF-32")


def _numeric_entity(number: Column) -> Column:
    windows = F.try_element_at(F.create_map(*[F.lit(x) for pair in _BYTES.items() for x in pair]), number)
    unassigned = (number.between(1, 8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F)
                  | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE))
    return (F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), _REPLACEMENT)
            .when(number.between(0x80, 0x9F), F.coalesce(windows, _character(number)))
            .when(unassigned, "").otherwise(_character(number)))


def _entity_value(entity: Column) -> Column:
    """What one entity stands for; what is none stays as it is."""
    # Leading zeros mean nothing, and eight digits are too many for a character in either base.
    digits = F.substring(F.ltrim(F.regexp_extract(entity, r"^&#[xX]?([0-9a-fA-F]+)", 1), F.lit("0")), 1, 8)
    base16 = F.lower(F.substring(entity, 3, 1)) == "x"
    number = F.when(digits == "", 0).when(base16, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.cast("bigint"))
    table = F.str_to_map(F.lit("\x02".join(f"{name}\x01{value}" for name, value in _NAMES.items())),
                         F.lit("\x02"), F.lit("\x01"))

    def named(name):
        prefix = F.regexp_extract(name, f"^(?:{'|'.join(_OPEN_NAMES)})", 0)
        open_name = bind(prefix, lambda found: F.when(found != "", F.concat(
            F.try_element_at(table, found), F.substring(name, F.length(found) + 1, MAX_LENGTH))))
        return F.coalesce(F.try_element_at(table, name), open_name)

    value = bind(F.substring(entity, 2, MAX_LENGTH), named)
    return F.when(entity.startswith("&#"), bind(number, _numeric_entity)).otherwise(F.coalesce(value, entity))


def unescape(text: Column) -> Column:
    """Decode HTML entities, as browsers and Python's ``html.unescape`` do.

    The text is cut at its entities, each is looked up, and the pieces are joined again. Texts without an
    ampersand are passed on. :func:`bind` the result where it is used several times.
    """
    def decode(whole):
        values = F.transform(find_all(whole, _ENTITY, 0), _entity_value)
        return F.array_join(F.zip_with(F.split(whole, _ENTITY, -1), values, lambda piece, value: F.concat(
            piece, F.coalesce(value, F.lit("")))), "")
    return bind(text, lambda whole: F.when(whole.contains("&"), decode(whole)).otherwise(whole))
