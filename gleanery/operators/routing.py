"""Which fetcher and which extractor a row gets.

Rules are few and known when the plan is made, so they fold into one lazy CASE
expression per row: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, text as tx

# What the built-in extractors accept.
TEXT_EXTENSIONS = (".txt", ".md", ".rst", ".log", ".cfg", ".ini", ".conf")
TEXT_PREFERRED = ("text/plain", "text/markdown", "text/x-rst", "text/x-log", "text/x-config")
HTML_EXTENSIONS = (".html", ".htm", ".xhtml")
HTML_MIME_TYPES = ("text/html", "application/xhtml+xml")

SUCCESS, ERROR = "success", "error"


@dataclass(frozen=True)
class Fetcher:
    """`can` tells from the URL; `read` turns rows with source_url/path into fetched rows."""

    name: str
    can: Callable[[Column], Column]
    read: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Extractor:
    """`can` tells from URL and MIME type, `text` maps content to the extracted text.

    A title is made in two steps so that searching the content happens once: `find_title`
    looks it up in the content, `title` settles on (given title, found title).

    `members`, if set, makes it a container: it maps content to an array of
    struct<name, mime_type, content_text>, each of which is routed again. Members may have
    `content_binary` besides.

    `text`, `find_title` and `members` get the content as text, null if it is not valid UTF-8. One that
    takes two arguments gets the bytes as well (null if the content came as text).

    `arrow`, in place of `text` and `find_title`, is any Python function on Arrow arrays; see `operators.arrow_extract`.
    """

    name: str
    can: Callable[[Column, Column], Column]
    preferred: tuple[str, ...] = ()
    text: Callable[[Column], Column] | None = None
    find_title: Callable[[Column], Column] | None = None
    title: Callable[[Column, Column], Column] | None = None
    members: Callable[[Column], Column] | None = None
    arrow: Callable | None = None


def can_fetch_file(url: Column, exists: Column | None = None) -> Column:
    """file: URLs, and bare paths of files that exist."""
    scheme = paths.url_scheme(url)
    known = F.lit(False) if exists is None else F.coalesce(exists, F.lit(False))
    return (scheme == "file") | ((scheme == "") & known)


def can_fetch_http(url: Column) -> Column:
    return paths.url_scheme(url).isin("http", "https")


def _by_mime_or_url(mime: Column, by_mime: Column, url: Column, extensions) -> Column:
    return F.when(tx.non_empty(mime).isNotNull(), by_mime).otherwise(
        paths.url_ends_with(url, extensions)
    )


def can_extract_text(url: Column, mime: Column) -> Column:
    return _by_mime_or_url(mime, mime.startswith("text/"), url, TEXT_EXTENSIONS)


def can_extract_html(url: Column, mime: Column) -> Column:
    return _by_mime_or_url(mime, mime.isin(*HTML_MIME_TYPES), url, HTML_EXTENSIONS)


FILE_FETCHER = Fetcher("file", can_fetch_file)
HTTP_FETCHER = Fetcher("http", can_fetch_http)
# Schemes of file systems and object stores that listings come from.
STORE_SCHEMES = ("hdfs", "viewfs", "webhdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "dbfs")
STORE_FETCHER = Fetcher("store", lambda url: paths.url_scheme(url).isin(*STORE_SCHEMES))
TEXT_EXTRACTOR = Extractor(
    "text", can_extract_text, TEXT_PREFERRED, lambda c: c, tx.first_line, tx.finish_text_title
)
HTML_EXTRACTOR = Extractor(
    "html", can_extract_html, HTML_MIME_TYPES, tx.html_text, tx.page_title, tx.finish_html_title
)
# The messages of both routing steps, below. The order is the priority.
FETCHERS = (FILE_FETCHER, HTTP_FETCHER)
EXTRACTORS = (TEXT_EXTRACTOR, HTML_EXTRACTOR)


def first_of(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Name of the first condition that holds, null if none does."""
    if not pairs:
        return F.lit(None).cast("string")
    case = F
    for cond, name in pairs:
        case = case.when(cond, F.lit(name))
    return case


def pipeline_mime(mime: Column) -> Column:
    """Inside the pipeline a missing type is octet-stream, so URLs are never consulted."""
    return F.coalesce(tx.non_empty(mime), F.lit(paths.OCTET_STREAM))


def choose_extractor(url: Column, mime: Column, extractors=EXTRACTORS) -> Column:
    """First that can and prefers the type, else first that can."""
    return first_of(
        [(e.can(url, mime) & mime.isin(*e.preferred), e.name) for e in extractors if e.preferred]
        + [(e.can(url, mime), e.name) for e in extractors]
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters refer to but do not copy.

    Catalyst pushes a filter below a projection by substituting the expression, which
    for a long CASE means evaluating it several times. It does not do so for a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def route_fetch(df: DataFrame, fetchers=FETCHERS) -> DataFrame:
    url = F.col("source_url")
    found = F.col("fetcher").isNotNull()
    return _once(df, "fetcher", first_of([(f.can(url), f.name) for f in fetchers])).withColumns(
        {
            "route_status": F.when(found, SUCCESS).otherwise(ERROR),
            "message": F.concat(
                F.when(found, F.lit("Fetched content from ")).otherwise(
                    F.lit("No fetcher found for URL: ")
                ),
                url,
            ),
        }
    )


def route_extract(df: DataFrame, extractors=EXTRACTORS) -> DataFrame:
    df = df.withColumns(
        {
            "__url": paths.default_source_url(F.col("source_url")),
            "__mime": pipeline_mime(F.col("mime_type")),
        }
    )
    found = F.col("extractor").isNotNull()
    chosen = choose_extractor(F.col("__url"), F.col("__mime"), extractors)
    return (
        _once(df, "extractor", chosen)
        .withColumns(
            {
                "route_status": F.when(found, SUCCESS).otherwise(ERROR),
                "message": F.when(found, F.lit("Content extraction completed")).otherwise(
                    F.concat(F.lit("No extractor found for content type: "), F.col("__mime"))
                ),
            }
        )
        .drop("__url", "__mime")
    )


def extractor_rank(df: DataFrame, keep: list[str], extractors=EXTRACTORS) -> DataFrame:
    """Every extractor that can take the row, best first. Ranked inside the row."""
    url = paths.default_source_url(F.col("source_url"))
    mime = pipeline_mime(F.col("mime_type"))
    options = [
        F.struct(
            (~mime.isin(*e.preferred)).alias("not_preferred"),
            F.lit(i).alias("priority"),
            F.lit(e.name).alias("extractor"),
            e.can(url, mime).alias("can"),
        )
        for i, e in enumerate(extractors, 1)
    ]
    ranked = F.array_sort(F.filter(F.array(*options), lambda o: o["can"]))
    return df.select(*keep, F.posexplode(ranked).alias("pos", "option")).select(
        *keep,
        (F.col("pos") + 1).alias("rank"),
        F.col("option.extractor").alias("extractor"),
        (~F.col("option.not_preferred")).alias("preferred"),
        F.col("option.priority").alias("priority"),
    )
