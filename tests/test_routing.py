import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanery.functions import paths
from gleanery.operators import routing as ro
from gleanery.operators.extract import extract, extract_nested, stored_rows, to_items
from gleanery.plans.registry import Registry


@pytest.mark.parametrize(
    "name, extractor",
    [
        ("a.txt", "text"), ("a.md", "text"), ("a.html", "html"), ("a.htm", "html"), ("a.TXT", "text"),
        ("a.json", None), ("a.xml", None), ("a.pdf", None), ("a.doc", None), ("a.docx", None),
        ("a.rst", None), ("a.log", None), ("a.xhtml", None), ("a.zip", None), ("a", None),
    ],
)
def test_files_by_suffix(spark, name, extractor):
    df = spark.createDataFrame([(f"file:///{name}",)], "source_url string")
    r = ro.route_extract(df.withColumn("mime_type", paths.mime_from_path(F.col("source_url")))).first()
    assert r.extractor == extractor
    assert r.route_status == ("success" if extractor else "error")


def test_by_type(spark):
    types = ["application/xhtml+xml", "text/csv", "text/html", "TEXT/HTML", None, "", "text/x-rst"]
    df = spark.createDataFrame([(i, "u.txt", m) for i, m in enumerate(types)], "i int, source_url string, mime_type string")
    got = [r.extractor for r in ro.route_extract(df).orderBy("i").collect()]
    assert got == ["html", "text", "html", None, None, None, "text"]


def test_fetchers(spark):
    urls = ["file:///a", "http://a", "HTTPS://a", "ftp://a", "test://a", "plain.txt"]
    df = spark.createDataFrame([(u,) for u in urls], "source_url string")
    got = {r.source_url: (r.fetcher, r.route_status, r.message) for r in ro.route_fetch(df).collect()}
    assert [got[u][0] for u in urls] == ["file", "http", "http", None, None, None]
    assert got["ftp://a"][1:] == ("error", "No fetcher found for URL: ftp://a")


def test_predicates_without_a_type(spark):
    urls = ["FILE.HTML", "a.xhtml", "a.Conf", "a.rst", "a.json", "txt"]
    df = spark.createDataFrame([(u, None) for u in urls], "u string, m string")
    got = {
        r.u: (r.t, r.h)
        for r in df.select(
            "u",
            ro.can_extract_text(F.col("u"), F.col("m")).alias("t"),
            ro.can_extract_html(F.col("u"), F.col("m")).alias("h"),
        ).collect()
    }
    assert [got[u] for u in urls] == [
        (False, True), (False, True), (True, False), (True, False), (False, False), (False, False),
    ]


def test_bare_paths_need_an_existing_file(spark):
    df = spark.createDataFrame([("a.txt", True), ("b.txt", None), ("file:///c", None)], "u string, e boolean")
    got = df.select(ro.can_fetch_file(F.col("u"), F.col("e"))).collect()
    assert [r[0] for r in got] == [True, False, True]


def test_rank(spark):
    df = spark.createDataFrame([("u", "text/html"), ("v", "text/csv"), ("w", "x/y")], "source_url string, mime_type string")
    assert rows(ro.extractor_rank(df, ["source_url"])) == [
        ("u", 1, "html", True, 2), ("u", 2, "text", False, 1), ("v", 1, "text", False, 1),
    ]


def fetched(spark, data):
    return spark.createDataFrame(
        data, "source_url string, title string, mime_type string, content_text string, content_binary binary"
    )


def test_extract(spark):
    df = fetched(
        spark,
        [
            ("t", None, "text/plain", "Head\nrest", None),
            ("g", "given", "text/plain", "Head\nrest", None),
            ("h", "given", "text/html", "<title>P</title><p>x</p>", None),
            ("b", None, "text/plain", None, bytearray("é".encode())),
            ("bad", None, "text/plain", None, bytearray(b"\xff")),
            ("no", None, "application/pdf", "x", None),
            (None, None, "text/plain", "x", None),
        ],
    )
    got = {r.source_url: r for r in extract(df).collect()}
    assert (got["t"].title, got["t"].content_text, got["t"].mime_type, got["t"].processing_state) == (
        "Head", "Head\nrest", "text/plain", "extracted",
    )
    assert got["g"].title == "given"
    assert (got["h"].title, got["h"].content_text) == ("P", "P x")
    assert got["b"].content_text == "é"
    assert (got["bad"].route_status, got["bad"].error) == ("success", "content is not valid UTF-8")
    assert got["no"].route_status == "error" and got["no"].mime_type == "application/pdf"
    assert "unknown" in got
    assert {r[0] for r in stored_rows(extract(df)).select("source_url").collect()} == {"t", "g", "h", "b", "unknown"}


def test_items_hash_the_extracted_text(spark):
    df = fetched(spark, [("h", None, "text/html", "<p>x</p>", None), ("t", None, "text/plain", "x", None)])
    items = to_items(stored_rows(extract(df)).withColumn("insert_seq", F.lit(1)))
    assert len({r.content_hash for r in items.collect()}) == 1
    assert len({r.item_id for r in items.collect()}) == 2
    assert "content_text" not in items.columns


def test_custom_extractor_is_preferred_when_it_says_so(spark):
    registry = Registry()
    registry.register_extractor("md", lambda u, m: m.startswith("text/"), ("text/x-new",), fn=F.upper)
    df = fetched(
        spark, [("a", "t", "text/x-new", "x", None), ("b", "t", "text/plain", "x", None), ("c", "t", "text/csv", "x", None)]
    )
    assert rows(extract(df, registry.extractors), "source_url", "extractor", "content_text") == [
        ("a", "md", "X"), ("b", "text", "x"), ("c", "text", "x"),
    ]
    with pytest.raises(ValueError):
        registry.register_extractor("text", lambda u, m: F.lit(True))


def test_pandas_udf_extractor(spark):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def backwards(s):
        return s.str[::-1]

    registry = Registry().register_extractor("rev", lambda u, m: m == "x/rev", ("x/rev",), fn=backwards)
    df = fetched(spark, [("a", "t", "x/rev", "abc", None), ("b", "t", "text/plain", "abc", None)])
    assert rows(extract(df, registry.extractors), "source_url", "content_text") == [("a", "cba"), ("b", "abc")]


def boxes():
    """x/box holds `name=type=text` members separated by `;`, nested with other separators."""

    def members(sep, eq):
        def fn(text):
            parts = F.filter(F.split(text, sep), lambda p: p != "")
            return F.transform(
                parts,
                lambda p: F.struct(
                    F.split_part(p, F.lit(eq), F.lit(1)).alias("name"),
                    F.split_part(p, F.lit(eq), F.lit(2)).alias("mime_type"),
                    F.split_part(p, F.lit(eq), F.lit(3)).alias("content_text"),
                ),
            )

        return fn

    return (
        Registry()
        .register_extractor("box", lambda u, m: m == "x/box", members=members(";", "="))
        .register_extractor("inner", lambda u, m: m == "x/inner", members=members(",", ":"))
        .register_extractor("loop", lambda u, m: m == "x/loop", members=lambda t: F.array(
            F.struct(F.lit("again").alias("name"), F.lit("x/loop").alias("mime_type"), t.alias("content_text"))
        ))
    )


def test_nested(spark):
    box = "a=text/plain=hello;b=text/html=<p>x</p>;c=x/inner=d:text/plain:deep,e:image/png:?;"
    df = fetched(spark, [("box", None, "x/box", box, None), ("flat", None, "text/plain", "flat", None), ("none", None, "x/box", "", None)])
    df = df.withColumn("author", F.lit("me"))
    got = extract_nested(df, boxes().extractors)
    assert rows(got, "source_url", "parent_url", "depth", "content_text", "author") == [
        ("box/a", "box", 1, "hello", "me"),
        ("box/b", "box", 1, "x", "me"),
        ("box/c/d", "box/c", 2, "deep", "me"),
        ("box/c/e", "box/c", 2, None, "me"),
        ("flat", None, 0, "flat", "me"),
        ("none", None, 0, None, "me"),
    ]
    errors = {r.source_url: r.error for r in got.collect() if r.error}
    assert errors == {
        "box/c/e": "No extractor found for content type: image/png",
        "none": "container has no members",
    }


def test_nesting_without_end_is_reported(spark):
    df = fetched(spark, [("l", None, "x/loop", "x", None)])
    got = extract_nested(df, boxes().extractors).collect()
    assert [(r.source_url, r.error) for r in got] == [("l/again", "container holds itself")]


@pytest.mark.parametrize("levels", [1, 3, 4])
def test_any_depth(spark, levels):
    """Six levels, by passes of any number of levels; the innermost is text."""
    def inner(t):
        rest = F.substring(t, 2, 1000)
        kind = F.when(rest.startswith("("), F.lit("x/nest")).otherwise(F.lit("text/plain"))
        return F.array(F.struct(F.lit("in").alias("name"), kind.alias("mime_type"), rest.alias("content_text")))

    registry = Registry().register_extractor("nest", lambda u, m: m == "x/nest", members=inner)
    df = fetched(spark, [("six", None, "x/nest", "((((((core", None), ("two", None, "x/nest", "((core", None)])
    got = extract_nested(df, registry.extractors, levels)
    assert rows(got, "source_url", "depth", "content_text") == [
        ("six" + "/in" * 6, 6, "core"), ("two" + "/in" * 2, 2, "core"),
    ]


def test_bytes_for_extractors(spark):
    """An extractor and a container that take the bytes; others say that there is no text."""
    def pages(text, binary):
        part = F.substring(binary, 2, 100)
        return F.array(F.struct(F.lit("p").alias("name"), F.lit("x/raw").alias("mime_type"), F.lit(None).cast("string").alias("content_text"), part.alias("content_binary")))

    registry = (
        Registry()
        .register_extractor("raw", lambda u, m: m == "x/raw", fn=lambda text, binary: F.hex(binary))
        .register_extractor("zip", lambda u, m: m == "x/zip", members=pages)
        .register_extractor("deaf", lambda u, m: m == "x/deaf", members=lambda t: F.array(
            F.struct(F.lit("n").alias("name"), F.lit("text/plain").alias("mime_type"), t.alias("content_text"))))
    )
    data = bytearray(b"\xff\xfe\x00")
    df = fetched(spark, [
        ("r", None, "x/raw", None, data), ("z", None, "x/zip", None, data), ("d", None, "x/deaf", None, data),
        ("t", None, "text/plain", None, data),
    ])
    got = {r.source_url: (r.content_text, r.error) for r in extract_nested(df, registry.extractors).collect()}
    assert got == {
        "r": ("FFFE00", None), "z/p": ("FE00", None),
        "d": (None, "content is not valid UTF-8"), "t": (None, "content is not valid UTF-8"),
    }
