"""Extractors that are Python functions: their own rows only, and failures row by row."""

import json

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanery.operators import arrow_extract as ax
from gleanery.operators.extract import extract, extract_nested
from gleanery.operators.items import ItemsTable
from gleanery.plans.indexing import index_folder
from gleanery.plans.registry import Registry
from gleanery.session import work_dir

JSON = "application/json"


def _names_only():
    """Accepts JSON objects and nothing else. A local function, as workers do not have this module."""
    return lambda texts: [json.loads(t)["name"] for t in texts.to_pylist()]


names_only = _names_only()


def json_registry(fn, **more):
    return Registry().register_extractor("json", lambda u, m: m == JSON, (JSON,), arrow=fn, **more)


def docs(spark, *data):
    return spark.createDataFrame(
        [(f"file:///d/{i}", m, t, b, i) for i, (m, t, b) in enumerate(data)],
        "source_url string, mime_type string, content_text string, content_binary binary, insert_seq long",
    )


def test_own_rows_only(spark):
    df = docs(spark, (JSON, '{"name": "a"}', None), ("text/plain", "no json", None), (JSON, '{"name": "b"}', None), (JSON, None, None), (None, "x", None))
    got = rows(extract(df, json_registry(names_only).extractors), "source_url", "content_text", "extractor", "error")
    assert [r[1:] for r in got[:4]] == [("a", "json", None), ("no json", "text", None), ("b", "json", None), (None, "json", "content is not valid UTF-8")]
    assert got[4][2] is None and got[4][3]


def test_one_row_fails(spark):
    df = docs(spark, (JSON, '{"name": "a"}', None), (JSON, "broken", None), (JSON, '{"other": 1}', None), (JSON, '{"name": "d"}', None))
    got = rows(extract(df.coalesce(1), json_registry(names_only).extractors), "source_url", "content_text", "error", "processing_state")
    assert [r[1] for r in got] == ["a", None, None, "d"]
    assert got[1][2].startswith("JSONDecodeError: ") and got[2][2] == "KeyError: 'name'"
    assert [r[3] for r in got] == ["extracted", "pending", "pending", "extracted"]


def test_titles_and_bytes(spark):
    def both(texts, raw):
        sizes = [len(t or b) for t, b in zip(texts.to_pylist(), raw.to_pylist())]
        return pa.chunked_array([[f"size {n}" for n in sizes]]), [f"title {n}" for n in sizes]

    df = docs(spark, (JSON, "four", None), (JSON, None, b"\xff\xfe\xfd")).withColumn("title", F.when(F.col("insert_seq") == 0, "given"))
    got = rows(extract(df, json_registry(both).extractors), "content_text", "title", "error")
    assert got == [("size 3", "title 3", None), ("size 4", "given", None)]


def test_what_a_function_may_give():
    texts, raw = pa.array(["a", None, "c"]), pa.nulls(3, pa.binary())
    assert ax.run(pc.utf8_upper, texts, raw) == [("A", None, None), (None, None, None), ("C", None, None)]
    assert ax.run(lambda t: t.to_pylist()[:1], texts, raw) == [("a", None, None), (None, None, None), ("c", None, None)]
    assert [r[2] for r in ax.run(lambda t: ["x"] * 7, texts, raw)] == ["ValueError: 7 values for 1 rows"] * 3
    assert [r[2] for r in ax.run(lambda t: 1, texts, raw)] == ["TypeError: 'int' object is not iterable"] * 3 or all(r[2] for r in ax.run(lambda t: 1, texts, raw))


def test_members_of_a_container(spark):
    registry = json_registry(names_only).register_extractor(
        "box", lambda u, m: m == "application/x-box",
        members=lambda c: F.transform(F.split(c, ";"), lambda x: F.struct(F.lit("m").alias("name"), F.lit(JSON).alias("mime_type"), x.alias("content_text"))),
    )
    df = docs(spark, ("application/x-box", '{"name": "a"};{"name": "b"};bad', None))
    got = rows(extract_nested(df, registry.extractors), "content_text", "depth", "error")
    assert [r[:2] for r in got] == [("a", 1), ("b", 1), (None, 1)] and got[2][2].startswith("JSONDecodeError")


def test_failures_of_an_index(spark, tmp_path):
    for name, text in (("a.json", '{"name": "x"}'), ("b.json", "bad"), ("c.txt", "plain")):
        (tmp_path / name).write_text(text)
    items = ItemsTable(spark, work_dir(spark, "items"))
    index_folder(spark, str(tmp_path), items, 1, registry=json_registry(names_only))
    assert items.read().count() == 2
    (failure,) = items.failures().collect()
    assert failure.stage == "extract" and failure.source_url.endswith("b.json") and failure.message.startswith("JSONDecodeError")


def test_one_kind_of_function():
    with pytest.raises(ValueError):
        Registry().register_extractor("u", lambda u, m: m == JSON, fn=lambda c: c, arrow=names_only)
