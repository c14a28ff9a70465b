"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def query_terms(query: Column) -> Column:
    """Words of three letters or more, in lower case, repeats kept."""
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda t: F.length(t) > 2)


def matched(terms: Column, text: Column) -> Column:
    return F.filter(terms, lambda t: F.contains(F.lower(text), t))


def fingerprint(text: Column, n: int = 100) -> Column:
    return trim_all(F.lower(F.substring(text, 1, n)))


#: The patterns and order that HTML is turned into text by. The first two take all up to the first closing
#: tag, which is what their published forms, with a loop over "<" that is no closing tag, match as well.
HTML_STEPS = [
    (r"(?is)<script\b.*?</script>", ""), (r"(?is)<style\b.*?</style>", ""), (r"<[^>]+>", " "),
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), (r"(?i)&[a-z]+;", ""),
    (r"\n\s*\n", "\n\n"), (r"[ \t]+", " "),
]
#: The patterns and order that Markdown marks are stripped by.
MARKDOWN_STEPS = [
    (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`(.+?)`", "$1"), (r"```[\s\S]*?```", ""), (r"\[(.+?)\]\(.+?\)", "$1"),
]


def _steps(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def html_to_text(html: Column) -> Column:
    return trim_all(_steps(html, HTML_STEPS))


def strip_markdown(text: Column) -> Column:
    return _steps(text, MARKDOWN_STEPS)


def sitemap_locs(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit("<loc>(.*?)</loc>"), F.lit(1))


def hash32(text: Column) -> Column:
    """The 32-bit hash h * 31 + c, signed, over a string's UTF-16 units."""
    wrap = lambda h: F.pmod(h + 2147483648, F.lit(4294967296)) - 2147483648

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c)
        high, low = 0xD800 + F.floor((code - 0x10000) / 0x400), 0xDC00 + (code - 0x10000) % 0x400
        return F.when(code < 0x10000, wrap(h * 31 + code)).otherwise(wrap((h * 31 + high) * 31 + low))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def base36(n: Column) -> Column:
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lower(F.conv(F.abs(n).cast("string"), 10, 36)))
