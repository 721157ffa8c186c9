"""Routed rows to extracted text, one projection."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import identity, metadata, paths
from ..session import work_dir
from ..sources.files import UNDECODABLE
from . import arrow_extract
from .routing import EXTRACTORS, choose_extractor, pipeline_mime, route_extract

NO_MEMBERS = "container has no members"
HOLDS_ITSELF = "container holds itself"


def with_content_columns(df: DataFrame) -> DataFrame:
    for name, kind in (("content_text", "string"), ("content_binary", "binary")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def takes_bytes(fn) -> bool:
    """Whether a function of an extractor asks for the bytes as well."""
    if fn is None:
        return False
    try:
        kinds = [p.kind for p in inspect.signature(fn).parameters.values() if p.default is p.empty]
    except (TypeError, ValueError):
        return False
    return sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds) == 2


def call(fn, text: Column, binary: Column) -> Column:
    return fn(text, binary) if takes_bytes(fn) else fn(text)


def content_as_text(text: Column, binary: Column) -> Column:
    return F.coalesce(text, F.try_validate_utf8(binary))


def extract(df: DataFrame, extractors=EXTRACTORS) -> DataFrame:
    """Fetched rows with metadata columns -> extracted rows.

    `route_status` says whether an extractor took the row, `error` whether it failed;
    only rows without both end up stored. Input text is replaced by extracted text.
    """
    df = metadata.with_defaults(with_content_columns(df))
    df = route_extract(df, extractors).withColumn(
        "__text", content_as_text(F.col("content_text"), F.col("content_binary"))
    )
    of_arrow = [e for e in extractors if e.arrow is not None]
    if of_arrow:
        df = arrow_extract.with_extracted(df, of_arrow, "__text")
    src, raw, chosen = F.col("__text"), F.col("content_binary"), F.col("extractor")
    of_bytes = [e.name for e in extractors if e.arrow is not None or takes_bytes(e.text)]
    readable = src.isNotNull() | (raw.isNotNull() & chosen.isin(*of_bytes)) if of_bytes else src.isNotNull()
    ok = chosen.isNotNull() & readable
    failure = (
        F.when(chosen.isNull(), F.col("message")).when(~readable, F.lit(UNDECODABLE))
    )
    if of_arrow:
        raised = F.col(arrow_extract.ERROR)
        ok, failure = ok & raised.isNull(), F.coalesce(failure, raised)
    if "error" in df.columns:
        failure = F.coalesce(F.col("error"), failure)
    df = df.withColumns(
        {
            "source_url": paths.default_source_url(F.col("source_url")),
            "content_text": _extracted(extractors, "text", src, raw, arrow_extract.TEXT),
            "__found": _extracted(extractors, "find_title", src, raw, arrow_extract.TITLE),
            "error": failure,
            "mime_type": F.when(ok, F.lit("text/plain")).otherwise(F.col("mime_type")),
            "processing_state": F.when(ok, F.lit("extracted")).otherwise(
                F.col("processing_state")
            ),
        }
    )
    title = _by_extractor(
        extractors, "title", lambda fn: fn(F.col("title"), F.col("__found")), F.col("title")
    )
    return df.withColumn("title", title).drop(
        "__text", "__found", "content_binary", arrow_extract.TEXT, arrow_extract.TITLE, arrow_extract.ERROR
    )


def _extracted(extractors, part: str, src: Column, raw: Column, by_arrow: str) -> Column:
    """What the chosen extractor's Column function gives, or its Arrow function gave before."""
    names = [e.name for e in extractors if e.arrow is not None]
    case = _by_extractor(extractors, part, lambda fn: call(fn, src, raw))
    return F.when(F.col("extractor").isin(*names), F.col(by_arrow)).otherwise(case) if names else case


def _by_extractor(extractors, part: str, call, otherwise: Column | None = None) -> Column:
    """CASE over the chosen extractor; only the chosen one's expression is evaluated."""
    case = F
    for e in extractors:
        fn = getattr(e, part)
        if fn is not None:
            case = case.when(F.col("extractor") == e.name, call(fn))
    if case is F:
        return F.lit(None).cast("string") if otherwise is None else otherwise
    return case if otherwise is None else case.otherwise(otherwise)


def to_items(df: DataFrame, *also: Column) -> DataFrame:
    """Rows ready to store: hash and metadata, no content, and the columns in `also`."""
    df = metadata.with_defaults(with_content_columns(df))
    hash_ = identity.content_hash(F.col("content_text"), F.col("content_binary"))
    return df.withColumn("content_hash", hash_).select(
        identity.item_id(F.col("source_url"), F.col("content_hash"), F.col("insert_seq")).alias(
            "item_id"
        ),
        F.col("insert_seq").cast("long").alias("insert_seq"),
        "content_hash",
        identity.content_type(F.col("content_text")).alias("content_type"),
        *metadata.METADATA.fieldNames(),
        *also,
    )


def stored_rows(extracted: DataFrame) -> DataFrame:
    return extracted.filter((F.col("route_status") == "success") & F.col("error").isNull())


def extract_nested(df: DataFrame, extractors, levels_per_pass: int = 3) -> DataFrame:
    """Containers opened level by level until none is left; every member is routed like any other row.

    A member's URL is parent/name and it inherits the parent's other metadata. A level is
    one generator that replaces a container by its members and hands all else on, so
    `levels_per_pass` levels are one pass over the input, without a shuffle. What a pass opens is written to the
    shared folder, and containers that are still closed then, those alone, are opened in a further pass. A container without members stays as an error row, and so does a member with
    the same type and content as its container, which would never end.
    """
    containers = [e for e in extractors if e.members is not None]
    rows = metadata.with_defaults(with_content_columns(df)).withColumns(
        {
            "depth": F.lit(0),
            "root_url": F.col("source_url"),
            "parent_url": F.lit(None).cast("string"),
            "open": F.lit(True),
        }
    )
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    if not containers:
        return extract(rows.drop("open"), extractors)
    done = []
    closed = 1
    while closed:
        for _ in range(levels_per_pass):
            rows = _open_containers(rows, extractors, containers)
        rows = rows.withColumn("__closed", F.coalesce(_container(rows, extractors, containers), F.lit(False)))
        # Opened once: what is written is parted into what is done and what the next pass goes on with.
        seen = Observation()
        path = work_dir(rows.sparkSession, "opened")
        rows.observe(seen, F.sum(F.col("__closed").cast("int")).alias("closed")).write.partitionBy("__closed").parquet(path)
        closed = seen.get["closed"] or 0
        kept = rows.drop("__closed")
        read = rows.sparkSession.read.schema(rows.schema).parquet(path)
        done.append(read.filter(~F.col("__closed")).select(*kept.columns))
        rows = read.filter("__closed").select(*kept.columns)
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return extract(found.drop("open"), extractors)


def _container(rows: DataFrame, extractors, containers) -> Column:
    url = paths.default_source_url(F.col("source_url"))
    chosen = choose_extractor(url, pipeline_mime(F.col("mime_type")), extractors)
    return F.col("open") & chosen.isin(*[e.name for e in containers])


_LEVEL = ("source_url", "parent_url", "mime_type", "content_text", "content_binary", "depth", "error")


def _with(fn, *fixed):
    return lambda m: fn(m, *fixed)


def _open_containers(rows: DataFrame, extractors, containers) -> DataFrame:
    url = paths.default_source_url(F.col("source_url"))
    chosen = choose_extractor(url, pipeline_mime(F.col("mime_type")), extractors)
    rows = rows.withColumn("__chosen", F.when(F.col("open"), chosen))
    text = content_as_text(F.col("content_text"), F.col("content_binary"))

    def member(m: Column, has_bytes: bool) -> Column:
        binary = m["content_binary"] if has_bytes else F.lit(None).cast("binary")
        same = (
            m["mime_type"].eqNullSafe(F.col("mime_type"))
            & m["content_text"].eqNullSafe(text)
            & binary.eqNullSafe(F.when(F.col("content_text").isNull() & text.isNull(), F.col("content_binary")))
        )
        return F.struct(
            F.concat_ws("/", F.col("source_url"), m["name"]).alias("source_url"),
            F.col("source_url").alias("parent_url"),
            m["mime_type"].alias("mime_type"),
            m["content_text"].alias("content_text"),
            binary.alias("content_binary"),
            (F.col("depth") + 1).alias("depth"),
            F.when(same, F.lit(HOLDS_ITSELF)).alias("error"),
            (~same).alias("open"),
        )

    level = F
    plain = [F.col(c) for c in _LEVEL if c != "error"]
    for e in containers:
        found = call(e.members, text, F.col("content_binary"))
        fields = rows.select(found.alias("m")).schema["m"].dataType.elementType.fieldNames()
        has_bytes = "content_binary" in fields
        members = F.transform(found, _with(member, has_bytes))
        unread = text.isNull() & F.lit(not takes_bytes(e.members))
        why = F.coalesce(F.col("error"), F.when(unread, F.lit(UNDECODABLE)).otherwise(F.lit(NO_MEMBERS)))
        itself = F.array(F.struct(*plain, why.alias("error"), F.lit(False).alias("open")))
        level = level.when(
            F.col("__chosen") == e.name, F.when(~unread & (F.coalesce(F.size(found), F.lit(0)) > 0), members).otherwise(itself)
        )
    same = F.array(F.struct(*plain, F.col("error"), F.lit(False).alias("open")))
    level = level.otherwise(same) if level is not F else same
    rest = [c for c in rows.columns if c not in (*_LEVEL, "open", "__chosen")]
    return rows.select(*rest, F.explode(level).alias("__m")).select(*rest, "__m.*")
