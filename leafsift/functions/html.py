"""HTML expressions that need no tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two clean-up patterns; open and close names may differ.
NOISE_ELEMENT = r"(?is)<(script|style|embed|object).*?>.*?</(script|style|embed|object)>"
BODY_TAG = r"(?is)</?body.*?>"

# Named entities decoded without a tree; the ampersand must come last.
NAMED_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&nbsp;": "\u00a0",
    "&copy;": "©",
    "&reg;": "®",
    "&middot;": "·",
    "&hellip;": "…",
    "&mdash;": "—",
    "&ndash;": "–",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&laquo;": "«",
    "&raquo;": "»",
}


def strip_noise(html: Column) -> Column:
    """Drop script, style, embed and object elements, and body tags."""
    return F.regexp_replace(F.regexp_replace(html, NOISE_ELEMENT, ""), BODY_TAG, "")


REPLACEMENT = "\ufffd"


def _code_point(number: Column) -> Column:
    """The character of a numeric reference; numbers that name none give the replacement character."""
    none = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    shown = F.when(none, F.lit(ord(REPLACEMENT))).otherwise(number)
    return F.decode(F.unhex(F.lpad(F.hex(shown), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Character references decoded in one pass from left to right, so nothing is decoded twice.

    Numeric references may be decimal or hexadecimal and of any length; names are those of NAMED_ENTITIES.
    """
    names = F.create_map(*[F.lit(x) for pair in {**NAMED_ENTITIES, "&amp;": "&"}.items() for x in pair])

    def number(part: Column, pattern: str, base: int) -> Column:
        digits = F.regexp_extract(part, pattern, 1)
        # more digits than any character has are beyond the range
        return F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(F.conv(digits, base, 10).cast("bigint"))

    def decoded(part: Column) -> Column:
        hexadecimal, decimal = r"^&#[xX]0*([0-9a-fA-F]+);$", r"^&#0*([0-9]+);$"
        return (
            F.when(~F.startswith(part, F.lit("&")), part)
            .when(part.rlike(hexadecimal), _code_point(number(part, hexadecimal, 16)))
            .when(part.rlike(decimal), _code_point(number(part, decimal, 10)))
            .otherwise(F.coalesce(F.try_element_at(names, part), part))
        )

    parts = F.regexp_extract_all(text, F.lit(r"(&#?[0-9a-zA-Z]+;|[^&]+|&)"), F.lit(1))
    return F.array_join(F.transform(parts, decoded), "")


def page_body(html: Column) -> Column:
    """Outer HTML of the body element, empty if there is none."""
    return F.regexp_extract(html, r"(?is)<body(?:\s[^>]*)?>(?:.*</body\s*>|.*)", 0)


def attribute(attrs: Column, name: str) -> Column:
    """Value of one attribute in raw tag source, null when absent."""
    pattern = rf"""(?is)(?:^|[\s"']){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    groups = [F.regexp_extract(attrs, pattern, i) for i in (1, 2, 3)]
    return F.when(attrs.rlike(pattern), F.concat(*groups))


def urls_in_json(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"""(?i)https?://[^"'><]+"""), F.lit(0))
