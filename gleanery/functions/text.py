"""Text and HTML expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Unicode-aware strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A run of the same characters. Java's Unicode \s lacks four control characters; naming
# the whole set one by one would be several times slower.
_WS_RUN = r"(?U)[\s\x1c-\x1f]+"

# What counts as markup. `u` makes `i` cover non-ASCII case pairs too.
_SCRIPT = r"(?isu)<script[^>]*>.*?</script>"
_STYLE = r"(?isu)<style[^>]*>.*?</style>"
_TAG = r"<[^>]+>"
_TITLE = r"(?isu)<title[^>]*>(.*?)</title>"

# Title length, the titles of last resort, bytes looked at for NUL.
TITLE_CHARS = 100
NO_TEXT_TITLE = "Untitled Document"
NO_HTML_TITLE = "Untitled HTML Document"
BINARY_PROBE_BYTES = 1024


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def non_empty(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, _WS_RUN, " ")


def html_text(html: Column) -> Column:
    """Script and style blocks dropped, tags blanked, whitespace collapsed.

    The passes stay separate: one alternation would pair tags differently when a
    style block opens inside a script block. Entities are left as they are.
    """
    c = F.regexp_replace(html, _SCRIPT, "")
    c = F.regexp_replace(c, _STYLE, "")
    c = F.regexp_replace(c, _TAG, " ")
    return F.trim(collapse_whitespace(c))


def page_title(html: Column) -> Column:
    """Body of the first title element; '' if it is empty or there is none."""
    return collapse_whitespace(strip(F.regexp_extract(html, _TITLE, 1)))


def html_title(html: Column) -> Column:
    """Body of the first title element, null if there is none."""
    found = F.regexp_extract(html, _TITLE, 0)
    return F.when(found != "", page_title(found))


def first_line(text: Column) -> Column:
    """First line of the stripped text, itself stripped."""
    # Only the left end has to be stripped before the line is cut out.
    return strip(F.substring_index(F.ltrim(text, F.lit(WHITESPACE)), "\n", 1))


def shorten(line: Column) -> Column:
    """The line as a title: cut when long, a fallback when empty."""
    cut = F.concat(F.substring(line, 1, TITLE_CHARS), F.lit("..."))
    return (
        F.when(F.length(line) > TITLE_CHARS, cut)
        .when(line != "", line)
        .otherwise(F.lit(NO_TEXT_TITLE))
    )


def text_title(text: Column) -> Column:
    return shorten(first_line(text))


def finish_text_title(given: Column, line: Column) -> Column:
    return F.coalesce(non_empty(given), shorten(line))


def finish_html_title(given: Column, found: Column) -> Column:
    return F.coalesce(non_empty(found), non_empty(given), F.lit(NO_HTML_TITLE))


def is_binary(content: Column) -> Column:
    """A NUL byte among the first bytes."""
    return F.contains(F.substring(content, 1, BINARY_PROBE_BYTES), F.lit(b"\0"))


def newlines(text: Column) -> Column:
    """CR LF and lone CR become LF. Most texts have none, which is quick to see."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def decode_text(content: Column) -> Column:
    """Strict UTF-8 with newline translation; null where the bytes are not UTF-8."""
    return newlines(F.try_validate_utf8(content))


def text_length(text: Column) -> Column:
    return F.length(text).cast("long")
