import hashlib
import json
import random
import re
import urllib.parse
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from gleanery.operators.merge import to_leaves
from gleanery.functions import identity, metadata, nested, paths, text as tx


def one(spark, value, kind, *exprs):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    r = df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()
    return r[0] if len(exprs) == 1 else tuple(r)


def many(spark, values, kind, fn):
    """fn over all values in one job."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v"))).collect())]


def test_whitespace_is_what_strip_removes():
    import sys

    assert set(tx.WHITESPACE) == {chr(i) for i in range(sys.maxunicode) if chr(i).isspace()}


def test_text_title(spark):
    cases = {
        "This is a test document.\nSecond line here.": "This is a test document.",
        "  \n ": "Untitled Document",
        "": "Untitled Document",
        "x" * 100: "x" * 100,
        "x" * 101: "x" * 100 + "...",
        "\n\n  first \u00a0\nsecond": "first",
        "\x1c\u2003head\u3000": "head",
        "a\r\nb": "a",
        "😀" * 101: "😀" * 100 + "...",
    }
    assert many(spark, cases, "string", tx.text_title) == list(cases.values())


HTML = [
    "<html><head><title> My\n  Page </title><style>p{}</style><script>var a='<b>';</script></head>"
    "<body><h1>Head</h1><p>a &amp; b</p></body></html>",
    "<script>x",
    "<SCRIPT type='a'>x</ScRiPt >y</script>z",
    "<script>1</script>keep<script>2</script>",
    "<style>a<script>b</style>c</script>d",
    "a<b\nc>d<>e< f",
    "a\u00a0\u2003b\x1c\x1dc\t\n d\u3000",
    "<\u017fcript>x</script>y",
    "<title></title>text",
    "<TITLE lang='x'>\u2028A\x1fB\u2028</TITLE>",
    "no markup",
    "",
    "<!-- a > b -->c",
]


def folded(html):
    """Lower case, one character for one; the letters that count as s and i besides."""
    also = {"\u017f": "s", "\u0131": "i", "\u0130": "i"}
    return "".join(also.get(c) or (c.lower() if len(c.lower()) == 1 else c) for c in html)


def element(html, name, at=0):
    """(start, inner start, inner end, end) of the next element of that name, or None."""
    low = folded(html)
    start = low.find("<" + name, at)
    inner = low.find(">", start) + 1 if start >= 0 else 0
    end = low.find(f"</{name}>", inner) if inner else -1
    return (start, inner, end, end + len(name) + 3) if end >= 0 else None


def scanned_text(html):
    for name in ("script", "style"):
        kept, at = [], 0
        while found := element(html, name, at):
            kept.append(html[at : found[0]])
            at = found[3]
        html = "".join(kept) + html[at:]
    out, at = [], 0
    while at < len(html):
        shut = html.find(">", at + 2) if html[at] == "<" and html[at + 1 : at + 2] != ">" else -1
        if shut > 0:
            out.append(" ")
            at = shut + 1
        else:
            out.append(html[at])
            at += 1
    return " ".join("".join(out).split())


def scanned_title(html):
    found = element(html, "title")
    return " ".join(html[found[1] : found[2]].split()) if found else None


def test_html(spark):
    assert many(spark, HTML, "string", tx.html_text) == [scanned_text(h) for h in HTML]
    assert many(spark, HTML, "string", tx.html_title) == [scanned_title(h) for h in HTML]


PIECES = [
    "<script", "<SCRIPT>", "</script>", "<\u017fcript>", "<scr\u0131pt>", "<scr\u0130pt>", "<style", "<style>", "</style>",
    "</STYLE >", "<title>", "</title>", "<TITLE x>", "<t\u0130tle>", "<p>", "<", ">", "<>", " ", "  ", "\n", "\r", "\t",
    "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000", "\ufeff",
    "a", "B", "é", "😀", "$1", "\\\\", "&amp;", "\0",
]


def test_random_markup(spark):
    rng = random.Random(11)
    pages = ["".join(rng.choices(PIECES, k=rng.randint(1, 30))) for _ in range(4000)]
    assert many(spark, pages, "string", tx.html_text) == [scanned_text(p) for p in pages]
    assert many(spark, pages, "string", tx.html_title) == [scanned_title(p) for p in pages]
    lines = [p.strip().split("\n")[0].strip() for p in pages]
    assert many(spark, pages, "string", tx.first_line) == lines
    assert many(spark, pages, "string", tx.newlines) == [p.replace("\r\n", "\n").replace("\r", "\n") for p in pages]


def test_long_input_does_not_overflow(spark):
    page = "<p>" * 50_000 + " \n" * 50_000 + "x" + "<script>" + "y" * 200_000 + "</script>"
    assert one(spark, page, "string", tx.html_text(F.col("v"))) == "x"


def test_resolved_titles(spark):
    lit = F.lit
    page = lambda h: tx.page_title(lit(h))
    assert one(
        spark, "", "string",
        tx.finish_text_title(lit("given"), tx.first_line(lit("text"))),
        tx.finish_text_title(lit(""), tx.first_line(lit("text"))),
        tx.finish_html_title(lit("given"), page("<title>page</title>")),
        tx.finish_html_title(lit("given"), page("<title></title>")),
        tx.finish_html_title(lit(None).cast("string"), page("<title></title>")),
        tx.finish_html_title(lit(""), page("no title")),
    ) == ("given", "text", "page", "given", "Untitled HTML Document", "Untitled HTML Document")


def test_bytes(spark):
    data = [b"a\0b", b"x" * 1024 + b"\0", b"x" * 1023 + b"\0", b"\xff\xfe", b"a\r\nb\rc\n", "é".encode()]
    data = [bytearray(d) for d in data]
    assert many(spark, data, "binary", tx.is_binary) == [True, False, True, False, False, False]
    assert many(spark, data, "binary", tx.decode_text)[3:] == [None, "a\nb\nc\n", "é"]


NAMES = [
    "/a/b.txt", "a.tar.gz", ".hidden", "..foo", "...foo", "foo.", "noext", "dir.d/file", "/x/y/",
    "UPPER.TXT", "a b.md", "a..b", ".a.b", "/", "é.html", "a\nb.txt",
]


def test_paths(spark):
    assert many(spark, NAMES, "string", paths.path_suffix) == [PurePosixPath(n).suffix for n in NAMES]
    assert many(spark, NAMES, "string", paths.file_name) == [PurePosixPath(n).name for n in NAMES]


@pytest.mark.parametrize("suffix, mime", paths.MIME_TYPES.items())
def test_known_types(spark, suffix, mime):
    assert many(spark, ["/a/B" + suffix.upper(), "x" + suffix], "string", paths.mime_from_path) == [mime, mime]


def test_unknown_types(spark):
    names = ["a.rst", "a.xhtml", "a", ".txt", "a.txt.bak"]
    assert set(many(spark, names, "string", paths.mime_from_path)) == {"application/octet-stream"}


def test_schemes(spark):
    urls = ["file:///a", "HTTP://x", "https:x", "a/b:c", "1a:b", "a+b.c-d:e", ":x", "", "plain.txt"]
    assert many(spark, urls, "string", paths.url_scheme) == [urllib.parse.urlparse(u).scheme for u in urls]


def test_file_uri(spark):
    paths_in = ["file:/a/b c.txt", "/a/é.txt", "file:///x", "s3a://bucket/k", "hdfs://nn/p"]
    assert many(spark, paths_in, "string", paths.file_uri) == [
        "file:///a/b c.txt", "file:///a/é.txt", "file:///x", "s3a://bucket/k", "hdfs://nn/p",
    ]


def test_default_source_url(spark):
    assert many(spark, [None, "", "u"], "string", paths.default_source_url) == ["unknown", "unknown", "u"]


def test_content_hash(spark):
    got = one(
        spark, "é\n", "string",
        identity.content_hash(F.col("v")),
        identity.content_hash(F.lit(None).cast("string"), F.lit(b"\xff\x00")),
    )
    assert got == (hashlib.sha256("é\n".encode()).hexdigest(), hashlib.sha256(b"\xff\x00").hexdigest())


UUID = "12345678-1234-5678-9abc-123456789abc"


def test_cache_ids(spark):
    encoded = one(
        spark, UUID, "string",
        identity.cache_id_encode(F.lit("test.plugin"), F.lit(".txt"), F.col("v"), F.lit(False)),
        identity.cache_id_encode(F.lit("p"), F.lit(None).cast("string"), F.col("v"), F.lit(True)),
    )
    assert encoded == (f"test.plugin|.txt|{UUID}|0", f"p||{UUID}|1")
    ids = [*encoded, "a|b|c", "a|b|c|d|e", "", "a|b|c|x"]
    got = many(spark, ids, "string", identity.cache_id_decode)
    assert [tuple(r) if r else None for r in got] == [
        ("test.plugin", ".txt", UUID, False), ("p", "", UUID, True), None, None, None, ("a", "b", "c", False),
    ]


def test_cache_paths(spark):
    files = {
        f"p/{UUID}.txt": ("p", ".txt", UUID, False),
        f"p/{UUID}": ("p", "", UUID, False),
        f"p/{UUID}.bin.jpg": ("p", ".jpg", UUID, True),
        f"p/{UUID}.bin": ("p", "", UUID, True),
        f"p/{UUID}.tar.gz": ("p", ".tar.gz", UUID, False),
        f"p/{UUID}.bin.bin": ("p", ".bin", UUID, True),
        "test.partition/not-a-valid-uuid.txt": None,
        f"p/{UUID}x": None,
        f"{UUID}.txt": None,
        f"p/q/{UUID}.txt": None,
    }
    got = many(spark, files, "string", identity.cache_path_decode)
    assert [tuple(r) if r else None for r in got] == list(files.values())
    assert one(
        spark, UUID, "string",
        identity.cache_file_name(F.col("v"), F.lit(".jpg"), F.lit(True)),
        identity.cache_file_name(F.col("v"), F.lit(".txt"), F.lit(False)),
        identity.cache_file_name(F.col("v"), F.lit(""), F.lit(False)),
        identity.cache_file_name(F.col("v"), F.lit(".bin"), F.lit(True)),
    ) == (f"{UUID}.bin.jpg", f"{UUID}.txt", UUID, f"{UUID}.bin")


def test_nested_look_ups(spark):
    record = json.dumps({"a": {"b": {"c": None, "d": [1, {"x": 2}]}}, "s": 3, "e": {}})
    r = F.parse_json("v")
    get = lambda p: nested.nested_get(r, p, F.lit("default"))
    assert one(
        spark, record, "string", get("a.b.c"), get("a.b.d"), get("a.b.x"), get("s.x"), get("e"), get("s")
    ) == ("null", '[1,{"x":2}]', "default", "default", "{}", "3")
    section = lambda p: nested.nested_section(r, p)
    assert one(spark, record, "string", section("e"), section("s"), section("none"), section("a")) == (
        "{}", "{}", "{}", '{"b":{"c":null,"d":[1,{"x":2}]}}',
    )


def test_leaves(spark):
    record = json.dumps({"b": {"x.y": {"q'r": 1}}, "a": [], "e": {}, "n": None, "t": "z", "f": 1.0})
    got = one(spark, record, "string", nested.leaves(F.col("v"), 3))
    assert sorted((list(r.path), r.kind, r.value_json) for r in got) == [
        (["a"], "list", "[]"), (["b", "x.y", "q'r"], "scalar", "1"), (["e"], "empty_object", "{}"),
        (["f"], "scalar", "1"), (["n"], "scalar", "null"), (["t"], "scalar", '"z"'),
    ]
    shallow = one(spark, record, "string", nested.leaves(F.col("v"), 2))
    assert [(list(r.path), r.value_json) for r in shallow if r.kind == nested.OPEN] == [(["b", "x.y"], '{"q\'r":1}')]


@pytest.mark.parametrize("levels", [1, 5, 8])
def test_leaves_of_any_depth(spark, levels):
    record = 1
    for i in reversed(range(12)):
        record = {f"k{i}": record, f"s{i}": i}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, '{"a":{}}'), (3, None)], "id long, record string")
    got = {(r.id, tuple(r.path)): r.value_json for r in to_leaves(df, ["id"], "record", levels).collect()}
    want = {(1, (*[f"k{j}" for j in range(i)], f"s{i}")): str(i) for i in range(12)}
    assert got == want | {(1, tuple(f"k{j}" for j in range(12))): "1", (2, ("a",)): "{}", (3, ()): None}


def test_metadata_json_round_trip(spark):
    df = metadata.with_defaults(spark.createDataFrame([("u", "t")], "source_url string, title string"))
    df = metadata.copy(df, extra_json=F.lit('{"a":{"b":1}}'), tags=F.array(F.lit("x")))
    m = metadata.to_json(df).select(metadata.from_json(F.col("metadata_json")).alias("m"), "metadata_json").first()
    assert json.loads(m.metadata_json) == {
        "source_url": "u", "title": "t", "processing_state": "pending", "tags": ["x"], "extra": {"a": {"b": 1}},
    }
    assert (m.m.source_url, m.m.author, m.m.tags, m.m.extra_json) == ("u", None, ["x"], '{"a":{"b":1}}')
    with pytest.raises(ValueError):
        metadata.copy(df, nonsense=F.lit(1))
