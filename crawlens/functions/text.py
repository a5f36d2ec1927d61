"""Text functions over columns: cleaning, robots directives, pixel widths, visible text of HTML by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths in pixels of characters in Arial at 20 px; any other character counts DEFAULT_WIDTH.
ARIAL_WIDTHS = {
    "a": 9.8, "b": 9.8, "c": 8.9, "d": 9.8, "e": 9.8, "f": 5.6, "g": 9.8, "h": 9.8, "i": 4.4, "j": 4.4, "k": 8.9, "l": 4.4, "m": 14.5,
    "n": 9.8, "o": 9.8, "p": 9.8, "q": 9.8, "r": 5.6, "s": 8.9, "t": 5.6, "u": 9.8, "v": 8.9, "w": 12.2, "x": 8.9, "y": 8.9, "z": 8.9,
    "A": 12.2, "B": 11.1, "C": 11.1, "D": 12.2, "E": 10.0, "F": 10.0, "G": 12.2, "H": 12.2, "I": 4.4, "J": 7.8, "K": 11.1, "L": 10.0, "M": 13.3,
    "N": 12.2, "O": 12.2, "P": 10.0, "Q": 12.2, "R": 11.1, "S": 10.0, "T": 10.0, "U": 12.2, "V": 11.1, "W": 15.6, "X": 11.1, "Y": 10.0, "Z": 10.0,
    "0": 9.8, "1": 9.8, "2": 9.8, "3": 9.8, "4": 9.8, "5": 9.8, "6": 9.8, "7": 9.8, "8": 9.8, "9": 9.8, " ": 5.0, "!": 5.6, '"': 7.1,
    "#": 9.8, "$": 9.8, "%": 15.6, "&": 11.7, "'": 3.9, "(": 5.6, ")": 5.6, "*": 6.7, "+": 10.3, ",": 5.0, "-": 5.6, ".": 5.0, "/": 5.6,
    ":": 5.6, ";": 5.6, "<": 10.3, "=": 10.3, ">": 10.3, "?": 9.8, "@": 17.8, "[": 5.6, "\\": 5.6, "]": 5.6, "^": 10.3, "_": 9.8, "`": 5.6,
    "{": 5.6, "|": 4.6, "}": 5.6, "~": 10.3,
}
DEFAULT_WIDTH = 9.6
#: White space as Python's str methods and regular expressions see it in HTML.
SPACES = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(text: Column | str) -> Column:
    """White space collapsed and trimmed; NULL if nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(_c(text), SPACES, " ")), F.lit(""))


def parse_int(value: Column | str) -> Column:
    """The integer of an attribute such as 120px or 50%; NULL if it is none."""
    bare = F.btrim(F.regexp_replace(F.btrim(_c(value)), r"[px%]+$", ""))
    return bare.try_cast("int")


def robots_tokens(value: Column | str) -> Column:
    parts = F.split(F.lower(F.coalesce(_c(value), F.lit(""))), r"[,\s]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def says_noindex(value: Column | str) -> Column:
    """Crawl-time reading: the token noindex or none."""
    return F.arrays_overlap(robots_tokens(value), F.array(F.lit("noindex"), F.lit("none")))


def contains_noindex(value: Column | str) -> Column:
    """Analysis-time reading: noindex anywhere in the directive."""
    return F.coalesce(F.lower(_c(value)).contains("noindex"), F.lit(False))


def page_nofollow(meta_robots: Column | str, x_robots: Column | str) -> Column:
    both = F.array_union(robots_tokens(meta_robots), robots_tokens(x_robots))
    return F.arrays_overlap(both, F.array(F.lit("nofollow"), F.lit("none")))


def pixel_width(text: Column | str, scale: float = 1.0) -> Column:
    """The width of a search result's line: 1.0 for titles (20 px), 0.7 for descriptions (14 px); half to even."""
    widths = F.create_map(*[F.lit(x) for kv in ARIAL_WIDTHS.items() for x in kv])
    chars = F.filter(F.split(F.coalesce(_c(text), F.lit("")), ""), lambda ch: ch != "")
    total = F.aggregate(chars, F.lit(0.0), lambda s, ch: s + F.coalesce(F.element_at(widths, ch), F.lit(DEFAULT_WIDTH)) * scale)
    return F.rint(total).cast("int")


def title_text(html: Column | str) -> Column:
    """The first title outside of svg, by expressions."""
    no_svg = F.regexp_replace(_c(html), r"(?is)<svg\b.*?</svg\s*>", " ")
    return clean(F.regexp_extract(no_svg, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def visible_text(html: Column | str) -> Column:
    """The body's text without script, style, noscript and template, tags replaced by a space."""
    body = F.regexp_extract(_c(html), r"(?is)<body[^>]*>(.*?)(?:</body\s*>|$)", 1)
    bare = F.regexp_replace(body, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(text), r"\s+"), lambda w: w != ""))


def text_ratio(html: Column | str, visible: Column | str) -> Column:
    """Visible characters per hundred of the source."""
    n = F.length(_c(html))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.length(_c(visible)) / n * 100, 2))


def heading_texts(html: Column | str, tag: str = "h1") -> Column:
    found = F.regexp_extract_all(_c(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(found, lambda h: clean(F.regexp_replace(h, r"(?s)<[^>]*>", " ")))
