"""Pages that were crawled elsewhere, as fetched rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.routing import can_fetch_http


def fetched_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> rows of the http fetcher, typed text/html."""
    return pages.filter(can_fetch_http(F.col("url"))).select(
        F.col("url").alias("source_url"),
        F.concat(F.lit("Content from "), F.col("url")).alias("title"),
        F.lit("text/html").alias("mime_type"),
        F.col("html").alias("content_text"),
        F.lit("http").alias("fetcher"),
        F.col("page_id").alias("insert_seq"),
    )
