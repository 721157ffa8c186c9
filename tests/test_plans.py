"""What the optimizer makes of the operators."""

import re

import pytest
from pyspark.sql import functions as F

from gleanery.operators import items as it, routing as ro, state as st
from gleanery.operators.extract import extract, extract_nested, stored_rows, to_items
from gleanery.plans import views as v
from gleanery.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df) -> set[str]:
    return set(re.findall(r"(\w+):", ",".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)))))


def docs(spark):
    return v.docs_with_type(spark, SF)


def test_routing_does_not_read_content(spark):
    assert read_columns(QUERIES["route_extract"](spark, SF)) == {"doc_id", "source"}
    assert "Exchange" not in plan(QUERIES["route_extract"](spark, SF))
    assert "Exchange" not in plan(QUERIES["extractor_rank"](spark, SF))


def test_the_case_is_evaluated_once(spark):
    text = plan(stored_rows(extract(docs(spark))))
    assert text.count("text/x-config") <= 2


def test_extraction_is_one_narrow_pass(spark):
    df = to_items(stored_rows(extract(docs(spark))))
    assert "Exchange" not in plan(df) and plan(df).count("FileScan") == 1
    containers = [*ro.EXTRACTORS, ro.Extractor("c", lambda u, m: m == "x", members=lambda t: F.array(
        F.struct(F.lit("n").alias("name"), F.lit("text/plain").alias("mime_type"), t.alias("content_text"))
    ))]
    df = extract_nested(docs(spark), containers)
    assert "Exchange" not in plan(df) and plan(df).count("FileScan") == 1
    assert "PythonUDF" not in plan(df) and "ArrowEval" not in plan(df)


@pytest.mark.parametrize("name", ["state_latest", "dedup_by_hash", "duplicate_groups", "first_item_per_url", "metadata_merge"])
def test_groups_are_folded_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_" in text.split("Exchange", 1)[1]


def test_skipping_reads_urls_only(spark):
    stored = v.table(spark, SF, "pages").select(F.col("url").alias("source_url"), F.col("html").alias("content_hash"))
    found = v.table(spark, SF, "pages").select(F.col("url").alias("source_url"))
    df = it.skip_existing(found, stored)
    assert "LeftAnti" in plan(df) and read_columns(df) == {"url"}


def test_filters_reach_the_scan(spark):
    latest = st.state_latest(v.state_log(spark, SF))
    text = plan(st.state_keys_with_value(latest, "click", "1"))
    assert "EqualTo(event_type,click)" in text
