"""Scalar functions on columns. All run in the JVM but `slug` of non-ASCII text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lengths that results depend on. White space, digits and word ends are those of Unicode;
# of lines, only line feeds count.
HEADING = r"(?mdU)^#{1,2}\s"
HEADING_AHEAD = r"(?mdU)^(?=#{1,2}\s)"
FIGURE_TAG = r"(?U)\[FIGURE_ID:\s*([0-9]+)\]"
CAPTION_WORDS = r"^(fig\.?|figure|chart|table)\b"
CAPTION = "(?iU)" + CAPTION_WORDS
CAPTION_KEY = r"(?iU)^((?:fig\.?\s*|figure\s*|chart\s*|table\s*)\d+)"
TABLE_RULE = r"(?U)^\s*\|[\s\-:|]+\|\s*$"
SLUG_LENGTH = 80
CAPTION_LENGTH = 120
MOST_HASHES = 6
JPEG = ("jpg", "jpeg")


# White space in the sense of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space, in the Unicode sense, at either end."""
    return F.trim(c, F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def tokens(c: Column) -> Column:
    """Estimated tokens of a text: one for every four characters."""
    return F.floor(F.char_length(c) / 4).cast("long")


def slug_ascii(c: Column) -> Column:
    """File-name form of ASCII text."""
    kept = F.regexp_replace(F.lower(c), r"[^\w\s-]", "")
    joined = F.regexp_replace(kept, r"[-\s]+", "_")
    return F.substring(F.regexp_replace(joined, r"^_+|_+$", ""), 1, SLUG_LENGTH)


def slug(c: Column) -> Column:
    """File-name form of any text: decomposed, what isn't ASCII dropped."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    plain = c.rlike(r"^[\x00-\x7F]*$")
    return slug_ascii(F.when(plain, c).otherwise(folded(F.when(~plain, c))))


def output_slug(c: Column) -> Column:
    return F.coalesce(F.nullif(slug(c), F.lit("")), F.lit("untitled_document"))


def figure_tags(c: Column) -> Column:
    """The figure ids tagged in a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(FIGURE_TAG), 1), lambda x: x.cast("long"))


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION)


def caption_key(c: Column) -> Column:
    """Keyword and number of a caption, lower-case and single-spaced; null without one."""
    key = F.regexp_extract(c, CAPTION_KEY, 1)
    return F.nullif(F.lower(F.regexp_replace(strip(key), r"(?U)\s+", " ")), F.lit(""))


def join_caption(parts: Column) -> Column:
    """One line of a list of caption strings."""
    return F.array_join(F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), strip), lambda x: x != ""), " ")


def wrap_latex(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("$")), c).otherwise(F.concat(F.lit("$$\n"), c, F.lit("\n$$")))


def heading_line(level: Column, text: Column) -> Column:
    marked = F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(MOST_HASHES))), F.lit(" "), text)
    return F.when(F.coalesce(level, F.lit(0)) > 0, marked).otherwise(text)


def data_uri(path: Column, content: Column) -> Column:
    """A data URI, its type by the suffix of the path."""
    jpeg = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*JPEG)
    return F.concat(F.lit("data:"), F.when(jpeg, "image/jpeg").otherwise("image/png"), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def json_slice(c: Column) -> Column:
    """The JSON value inside a model's answer: from the first bracket to the last one that closes it; null without any."""
    text = F.regexp_replace(c, r"```(?:json)?", "")
    first = F.regexp_extract(text, r"([\[{])", 1)
    begin = F.when(first == "[", F.instr(text, "[")).otherwise(F.instr(text, "{"))
    back = F.reverse(text)
    closing = F.when(first == "[", F.instr(back, "]")).otherwise(F.instr(back, "}"))
    size = F.char_length(text) - closing + 2 - begin
    return F.when((first != "") & (closing > 0) & (size > 0), F.substring(text, begin, size))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+00:00")


def substitute(template: Column | str, values: dict[str, Column]) -> Column:
    """$name in a template replaced by values; unknown names stay, longer names first."""
    out = F.lit(template) if isinstance(template, str) else template
    for name in sorted(values, key=len, reverse=True):
        for mark in (f"${{{name}}}", f"${name}"):
            out = F.replace(out, F.lit(mark), F.coalesce(values[name].cast("string"), F.lit("")))
    return out


# Character references that are resolved, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def table_markdown(c: Column) -> Column:
    """A pipe table of an HTML table; empty without rows.

    Cells lose their tags and runs of white space, a colspan gives empty cells after its own, rows are filled
    up to the longest, and rows without cells are dropped.
    """

    def plain(cell: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(cell, r"(?s)^<[^>]*>|</t[dh]\s*>$", ""), r"(?s)<[^>]*>", "")
        for mark, char in ENTITIES:
            text = F.replace(text, F.lit(mark), F.lit(char))
        return F.replace(strip(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))

    def spread(cell: Column) -> Column:
        span = F.regexp_extract(cell, r"""(?is)^<t[dh][^>]*\bcolspan\s*=\s*["']?(\d+)""", 1).try_cast("int")
        return F.concat(F.array(plain(cell)), F.array_repeat(F.lit(""), F.greatest(F.coalesce(span, F.lit(1)), F.lit(1)) - 1))

    rows = F.regexp_extract_all(c, F.lit(r"(?is)(<tr\b[^>]*>.*?</tr\s*>)"), 1)
    cells = F.transform(rows, lambda r: F.flatten(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)(<t[dh]\b[^>]*>.*?</t[dh]\s*>)"), 1), spread)))
    cells = F.filter(cells, lambda r: F.size(r) > 0)

    def piped(cells: Column, width: Column) -> Column:
        lines = F.transform(cells, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return bound(lines, lambda x: F.concat_ws("\n", F.try_element_at(x, F.lit(1)), rule, F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))))

    made = lambda found: bound(F.array_max(F.transform(found, F.size)), lambda width: piped(found, width))
    return bound(cells, lambda found: F.when(F.size(found) > 0, made(found)).otherwise(F.lit("")))
