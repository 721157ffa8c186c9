"""Listing, reading, indexing and streaming real files."""

import hashlib
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanery.operators import items as it, state as st
from gleanery.plans.indexing import index_folder, index_listing, index_sources
from gleanery.plans.registry import Registry
from gleanery.session import work_dir
from gleanery.sources import files as fi, listing
from gleanery.sources.union import union_sources
from gleanery.streaming import streams


def put(root, **files):
    for name, content in files.items():
        path = os.path.join(root, *name.split("/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def folder(tmp_path):
    put(
        tmp_path,
        **{
            "document.txt": "Document\r\nrest", "readme.md": "# Read me", "script.py": "x = 1", "data.json": "{}",
            "sub/nested.txt": "Nested", "page.html": "<title>Page</title><p>a &amp; b</p>", "shout.TXT": "LOUD",
            "odd name é.txt": "odd", "bin.txt": b"a\0b", "bad.txt": b"\xff\xfe", "raw.bin": b"\0\1",
        },
    )
    return str(tmp_path)


def names(df, col="source_url"):
    return sorted(r[0].rsplit("/", 1)[1] for r in df.select(col).collect())


def test_discover(spark, folder):
    got = fi.discover_files(spark, folder, [".txt", ".md"])
    assert names(got) == ["bad.txt", "bin.txt", "document.txt", "nested.txt", "odd name é.txt", "readme.md"]
    assert fi.discover_files(spark, folder).count() == 11
    row = got.filter("source_url like '%/sub/nested.txt'").first()
    assert row.source_url == f"file://{folder}/sub/nested.txt" and row.file_size == 6
    missing = fi.discover_files(spark, folder + "/none", [".txt"])
    assert missing.count() == 0 and missing.columns == got.columns


def test_list_files_lists_in_tasks_what_discover_files_lists(spark, tmp_path):
    root = str(tmp_path / "in")
    put(root, **{f"{i % 3}/deep er/%20 {i}.txt": "x" * (i + 1) for i in range(30)})
    put(root, **{"a.md": "a", ".hidden": "h", "_hidden/a.txt": "x", "_a=1/b.txt": "x", "empty.txt": "", "c._COPYING_": "c"})
    put(tmp_path, **{"linked/d.txt": "d"})
    os.symlink(str(tmp_path / "linked"), f"{root}/link")
    os.symlink(str(tmp_path / "none"), f"{root}/broken.txt")
    # A time that is no whole millisecond is cut and not rounded.
    os.utime(f"{root}/a.md", ns=(1_700_000_000_123_999_600,) * 2)
    for extensions, n in ((None, 33), ([".txt"], 32), ([".none"], 0)):
        for at in (root, f"file://{root}", f"{root}/"):
            got, want = fi.list_files(spark, at, extensions), fi.discover_files(spark, at, extensions)
            assert got.schema.simpleString() == want.schema.simpleString()
            assert rows(got) == rows(want) and got.count() == n
    plan = fi.list_files(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan filelist" in plan and "FileScan" not in plan
    # What is not one mounted folder is left to Spark's file source.
    for at in (f"{root}/[12]", f"{root}/a.md", f"{root}/none"):
        assert rows(fi.list_files(spark, at)) == rows(fi.discover_files(spark, at))


def test_index_folder_holds_no_paths_on_the_driver(spark, folder, monkeypatch):
    from gleanery.plans import indexing

    listed = []
    monkeypatch.setattr(indexing, "index_listing", lambda df, *a: listed.append(df))
    index_folder(spark, folder, it.ItemsTable(spark, work_dir(spark, "items")), 1, [".txt"])
    plan = listed[0]._jdf.queryExecution().optimizedPlan()
    assert "filelist" in plan.toString() and "binaryFile" not in plan.toString()
    assert names(listed[0]) == names(fi.discover_files(spark, folder, [".txt"]))


def test_a_folder_that_an_executor_does_not_have_is_not_empty(tmp_path):
    put(tmp_path, **{"in/a.txt": "a"})
    reader = listing.FileListSource({"path": str(tmp_path / "in"), "by": "names"}).reader(None)
    (part,) = reader.partitions()
    assert [r[0] for r in reader.read(part)] == [str(tmp_path / "in" / "a.txt")]
    os.rename(tmp_path / "in", tmp_path / "elsewhere")
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))


def test_listing_does_not_read_content(spark, folder):
    plan = fi.discover_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_read(spark, folder):
    for df in (fi.read_files(spark, folder), fi.read_listed(fi.balance_by_size(fi.discover_files(spark, folder)))):
        got = {r.title: r for r in df.collect()}
        assert len(got) == 11
        assert got["document.txt"].content_text == "Document\nrest"
        assert bytes(got["bin.txt"].content_binary) == b"a\0b" and got["bin.txt"].content_text is None
        assert got["bin.txt"].content_type == "blob" and got["bin.txt"].mime_type == "text/plain"
        assert got["bad.txt"].error == "content is not valid UTF-8"
        assert got["odd name é.txt"].content_text == "odd"


def test_unreadable_file_is_an_error_row(spark, folder):
    listed = fi.discover_files(spark, folder).withColumn(
        "path", F.when(F.col("path").endswith("readme.md"), F.lit("/no/such/file.md")).otherwise(F.col("path"))
    )
    got = fi.read_listed(listed).filter("title = 'file.md'").first()
    assert got.content_text is None and got.error.startswith("cannot read file")
    assert fi.read_listed(listed).filter("error is null").count() == 9


def test_large_batches_are_handed_on_in_parts(spark, folder, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fi, "CHUNK", 8)
    paths = [os.path.join(folder, n) for n in ("document.txt", "readme.md", "script.py", "data.json")]
    out = list(fi._read_batches(iter([pa.RecordBatch.from_pydict({"path": paths})])))
    assert [b.num_rows for b in out] == [1, 1, 2]
    assert [p for b in out for p in b.column("path").to_pylist()] == paths
    monkeypatch.setattr(fi, "MAX_CELL", 4)
    (only,) = fi._read_batches(iter([pa.RecordBatch.from_pydict({"path": paths[:1]})]))
    assert only.column("read_error").to_pylist() == ["file is too large for one row"]


@pytest.mark.parametrize("fanout", [1, 2, 256])
def test_listing_in_tasks(spark, folder, fanout):
    put(folder, **{".hidden": "h", "empty.txt": "", "a/b/c/deep.txt": "d", "a/x.txt": "x"})
    listing.register(spark)
    df = spark.read.format("filelist").option("path", folder).option("fanout", fanout).load()
    want = {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs}
    got = [r.path for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    assert spark.read.format("filelist").option("path", folder + "/none").load().count() == 0
    text = fi.read_listed(df).filter("title = 'empty.txt'").first()
    assert text.content_text == "" and text.error is None


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


STORED = {
    "document.txt": sha("Document\nrest"), "readme.md": sha("# Read me"), "nested.txt": sha("Nested"),
    "page.html": sha("Page a &amp; b"), "shout.TXT": sha("LOUD"), "odd name é.txt": sha("odd"), "bin.txt": sha("a\0b"),
}


def stored(items):
    got = [(r.source_url.rsplit("/", 1)[1], r.content_hash) for r in items.read().collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_index_folder(spark, folder):
    items = it.ItemsTable(spark, work_dir(spark, "items"))
    index_folder(spark, folder, items, 1)
    assert stored(items) == STORED
    page = items.read().filter("source_url like '%page.html'").first()
    assert (page.title, page.mime_type, page.processing_state) == ("Page", "text/plain", "extracted")
    # The same batch again changes nothing; the next one stores only what is new.
    index_folder(spark, folder, items, 1)
    assert stored(items) == STORED
    put(folder, **{"new.txt": "new", "readme.md": "changed"})
    index_folder(spark, folder, items, 2)
    assert stored(items) == {**STORED, "new.txt": sha("new")}
    assert items.batch(2).count() == 1


def test_only_new_files_are_read(spark, folder):
    items = it.ItemsTable(spark, work_dir(spark, "items"))
    index_folder(spark, folder, items, 1)
    os.chmod(os.path.join(folder, "readme.md"), 0)
    os.unlink(os.path.join(folder, "document.txt"))
    index_folder(spark, folder, items, 2)
    assert stored(items) == STORED


def test_index_sources(spark, folder):
    registry = Registry()
    registry.register_source("all", lambda s: fi.discover_files(s, folder))
    registry.register_source("texts", lambda s: fi.discover_files(s, folder, [".txt"]))
    registry.register_source("broken", lambda s: s.read.parquet("/no/such/table"))
    seen = []
    registry.register_store("count", lambda rows, batch: seen.append((batch, rows.count())))
    items = it.ItemsTable(spark, work_dir(spark, "items"))
    index_sources(spark, items, 1, registry)
    assert stored(items) == STORED and seen == [(1, len(STORED))]


def test_union_reports_broken_sources(spark):
    def broken(s):
        raise OSError("gone")

    got = union_sources(spark, {"a": lambda s: s.createDataFrame([("u",)], "source_url string"), "b": broken})
    assert rows(got, "source_url", "source", "error") == [("u", "a", None), (None, "b", "OSError")]
    assert union_sources(spark, {}).count() == 0


def test_streams(spark, folder):
    out = work_dir(spark, "stream")
    items = it.ItemsTable(spark, f"{out}/items")

    def run():
        listed = streams.discover_stream(spark, folder, max_files_per_batch=4)
        query = streams.index_stream(listed, items, f"{out}/checkpoint")
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    assert len(run()) == 3
    assert stored(items) == STORED
    put(folder, **{"new.txt": "new", "readme.md": "changed"})
    assert run() == [1]
    assert stored(items) == {**STORED, "new.txt": sha("new")}
    assert run() == []


def test_batch_cut_off_before_its_commit_is_done_again(spark, folder):
    out = work_dir(spark, "stream")
    items = it.ItemsTable(spark, f"{out}/items")
    calls = []

    def fail_once(df, batch):
        from gleanery.plans.indexing import index_listing

        index_listing(df, items, batch)
        calls.append(batch)
        if len(calls) == 1:
            raise RuntimeError("lost after storing")

    for attempt in (1, 2):
        listed = streams.discover_stream(spark, folder)
        try:
            streams.run(listed, fail_once, f"{out}/checkpoint").awaitTermination()
        except Exception:
            assert attempt == 1
    assert calls == [0, 0] and stored(items) == STORED


def log_files(spark, root, *batches):
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "partition_key string, key string, value_json string, version int, seq long")
        df.coalesce(1).write.mode("append").parquet(root)


def test_state_streams(spark):
    out = work_dir(spark, "stream")
    table = st.StateTable(spark, f"{out}/state")
    schema = "partition_key string, key string, value_json string, version int, seq long"

    def run():
        log = spark.readStream.schema(schema).parquet(f"{out}/log")
        streams.state_stream(log, table, f"{out}/c1").awaitTermination()
        latest = streams.latest_stream(spark.readStream.schema(schema).parquet(f"{out}/log"))
        streams.append_stream(latest, f"{out}/latest", f"{out}/c2", output_mode="update").awaitTermination()
        again = st.state_latest(spark.read.parquet(f"{out}/latest"), "batch_id")
        got = rows(table.latest())
        assert rows(again) == got
        return got

    log_files(spark, f"{out}/log", [("p", "a", "1", 1, 1), ("p", "a", "2", 3, 2), ("q", "a", "x", 1, 3)])
    assert run() == [("p", "a", "2", 3), ("q", "a", "x", 1)]
    log_files(spark, f"{out}/log", [("p", "a", "3", 1, 4), ("p", "b", "1", 1, 5)])
    assert run() == [("p", "a", "3", 1), ("p", "b", "1", 1), ("q", "a", "x", 1)]


def test_dedup_stream(spark):
    out = work_dir(spark, "stream")
    for batch in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(u,) for u in batch], "source_url string").coalesce(1).write.mode("append").parquet(f"{out}/in")
        urls = spark.readStream.schema("source_url string").parquet(f"{out}/in")
        streams.append_stream(streams.dedup_stream(urls), f"{out}/rows", f"{out}/c").awaitTermination()
    assert rows(spark.read.parquet(f"{out}/rows"), "source_url") == [("a",), ("b",), ("c",)]


def test_nothing_listed_is_lost(spark, tmp_path):
    """Every listed row is stored or a failure, whatever its scheme; a batch tried again changes nothing."""
    good = tmp_path / "good.txt"
    good.write_text("hello")
    urls = [f"file://{good}", f"file://{tmp_path}/none.txt", "http://host/page", "hdfs://nowhere:1/x.txt", "odd://x", "no scheme"]
    listed = spark.createDataFrame([(u, u) for u in urls], "source_url string, path string")
    items = it.ItemsTable(spark, str(tmp_path / "items"))
    for _ in range(2):
        index_listing(listed, items, 1)
        stored = {r.source_url for r in items.read().collect()}
        failed = {r.source_url: (r.stage, r.message) for r in items.failures().collect()}
        assert stored == {urls[0]} and set(failed) == set(urls[1:])
    assert {stage for stage, _ in failed.values()} == {"fetch"}
    assert failed["http://host/page"][1] == "No reader registered for fetcher: http"
    assert failed["odd://x"][1].startswith("No fetcher found") and "cannot read file" in failed[urls[1]][1]


def test_failing_source_does_not_stop_the_others(spark, tmp_path):
    """One source fails when it is opened, one while it is read."""
    good = tmp_path / "good.txt"
    good.write_text("hello")

    def late(s):
        return s.range(3).select(F.raise_error(F.lit("broken while read")).cast("string").alias("source_url"))

    def early(s):
        return s.read.parquet(str(tmp_path / "missing"))

    registry = Registry()
    registry.register_source("late", late).register_source("early", early)
    registry.register_source("good", lambda s: s.createDataFrame([(f"file://{good}",)], "source_url string"))
    items = it.ItemsTable(spark, str(tmp_path / "items"))
    index_sources(spark, items, 1, registry)
    assert [r.source_url for r in items.read().collect()] == [f"file://{good}"]
    assert {(r.source_url, r.stage) for r in items.failures().collect()} == {("late", "source"), ("early", "source")}
