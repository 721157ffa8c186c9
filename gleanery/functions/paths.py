"""Paths, URLs and MIME types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffix -> MIME type.
MIME_TYPES = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".html": "text/html",
    ".htm": "text/html",
    ".json": "application/json",
    ".xml": "application/xml",
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
OCTET_STREAM = "application/octet-stream"
UNKNOWN_URL = "unknown"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def path_suffix(path: Column) -> Column:
    """Last dot-suffix of the name; a leading or trailing dot starts none."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def mime_from_path(path: Column) -> Column:
    suffix = F.lower(path_suffix(path))
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit(OCTET_STREAM))


def url_scheme(url: Column) -> Column:
    """Lower-cased scheme, '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def file_uri(path: Column) -> Column:
    """`file:///…` for a local path, whatever number of slashes Spark lists it with.
    Paths that carry another scheme (s3a, hdfs, …) are URLs already."""
    local = F.regexp_replace(path, "^file:/*", "/")
    return F.when(url_scheme(path).isin("", "file"), F.concat(F.lit("file://"), local)).otherwise(
        path
    )


def default_source_url(url: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.lit(UNKNOWN_URL))


def has_suffix(path: Column, extensions) -> Column:
    """Case-sensitive allow-list; an empty list allows all."""
    exts = list(extensions or [])
    return path_suffix(path).isin(exts) if exts else F.lit(True)


def url_ends_with(url: Column, extensions) -> Column:
    """Case-insensitive test of the URL's end."""
    tail = "|".join(e.replace(".", r"\.") for e in extensions)
    return F.lower(url).rlike(rf"({tail})\z")
