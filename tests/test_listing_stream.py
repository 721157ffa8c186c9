"""Files listed as they arrive: batches, restarts, changes, offsets."""

import json
import os
import shutil
import time

import pytest
from conftest import rows

from gleanery.operators.items import ItemsTable
from gleanery.session import work_dir
from gleanery.sources import listing
from gleanery.sources.tables import read_batches
from gleanery.streaming import streams


def put(root, name, text="x"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def listed(spark, root, out, **options):
    stream = streams.listing_stream(spark, root, settle=0, **options)
    streams.append_stream(stream, f"{out}/files", f"{out}/checkpoint").awaitTermination()
    found = read_batches(spark, f"{out}/files", "path string, file_size long")
    return [(os.path.relpath(p, root.removeprefix("file://")), size) for p, size in rows(found, "path", "file_size")]


def test_what_arrives_is_listed_once(spark, tmp_path):
    root, out = str(tmp_path / "in"), work_dir(spark, "listing")
    os.makedirs(root)
    assert listed(spark, root, out) == []
    put(root, "a.txt"), put(root, "deep/er/b.txt"), put(root, ".hidden"), put(root, "empty", "")
    first = [(".hidden", 1), ("a.txt", 1), ("deep/er/b.txt", 1), ("empty", 0)]
    assert listed(spark, root, out) == first
    # Changed, new with old times, and moved here.
    put(root, "a.txt", "longer")
    os.utime(put(root, "old.txt"), (1, 1))
    shutil.move(put(str(tmp_path), "moved.txt"), root)
    assert listed(spark, root, out) == sorted([*first, ("old.txt", 1), ("moved.txt", 1)])
    assert listed(spark, root, out) == sorted([*first, ("old.txt", 1), ("moved.txt", 1)])


def test_without_a_record_of_paths_a_change_is_listed_again(spark, tmp_path):
    root, out = str(tmp_path / "in"), work_dir(spark, "listing")
    put(root, "a.txt"), put(root, "b.md"), put(root, "c.txt")
    assert listed(spark, f"file://{root}", out, once=False, extensions=[".txt"]) == [("a.txt", 1), ("c.txt", 1)]
    put(root, "a.txt", "longer")
    assert listed(spark, f"file://{root}", out, once=False, extensions=[".txt"]) == [("a.txt", 1), ("a.txt", 6), ("c.txt", 1)]


def test_offsets_do_not_grow(spark, tmp_path):
    root, out = str(tmp_path / "in"), work_dir(spark, "listing")
    for n in range(3):
        for i in range(50):
            put(root, f"{n}/{i}.txt")
        listed(spark, root, out)
    logs = [f for f in os.listdir(f"{out}/checkpoint/offsets") if f.isdigit()]
    for f in logs:
        with open(f"{out}/checkpoint/offsets/{f}") as log:
            assert json.loads(log.read().splitlines()[-1]).keys() == {"until"}
    assert read_batches(spark, f"{out}/files").count() == 150


def test_a_batch_that_is_cut_off_is_done_again(spark, tmp_path):
    root, out = str(tmp_path / "in"), work_dir(spark, "listing")
    put(root, "a.txt"), put(root, "b.txt")
    seen = []

    def fail_once(df, batch):
        seen.append(sorted(r.path for r in df.collect()))
        if len(seen) == 1:
            raise RuntimeError("cut off")

    for attempt in range(2):
        query = streams.run(streams.listing_stream(spark, root, settle=0), fail_once, f"{out}/checkpoint")
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001
            assert attempt == 0
        put(root, "c.txt")
    assert len(seen[0]) == 2 and seen[1] == seen[0]
    assert sum(seen[1:], []) in (seen[0], [*seen[0], f"{root}/c.txt"])


def test_index_stream_skips_what_is_stored(spark, tmp_path):
    root, out = str(tmp_path / "in"), work_dir(spark, "listing")
    items = ItemsTable(spark, f"{out}/items")
    for names in (["a.txt", "b.txt"], ["a.txt", "c.txt"]):
        for n in names:
            put(root, n, f"text of {n}")
        streams.index_stream(streams.listing_stream(spark, root, once=False, settle=0), items, f"{out}/checkpoint").awaitTermination()
    assert [r[0] for r in rows(items.read(), "title")] == ["a.txt", "b.txt", "c.txt"]


def test_looks_are_spaced():
    reader = listing.ArrivalReader({"path": "/", "settle": "0", "every": "0.2"})
    first = reader.latestOffset()
    assert reader.latestOffset() == first
    time.sleep(0.25)
    assert reader.latestOffset()["until"] > first["until"]
    later = listing.ArrivalReader({"path": "/", "settle": "100", "every": "0"})
    assert later.latestOffset()["until"] < time.time_ns() - 99e9


def test_paths():
    assert listing.local_path("file:///a b/c%20") == listing.local_path("file:/a b/c%20") == "/a b/c%20"
    with pytest.raises(ValueError):
        listing.local_path("s3a://bucket/x")


def discovered(spark, root, out, **options):
    """What the folder's stream has found so far, and how many batches it took."""
    query = streams.append_stream(streams.discover_stream(spark, root, **options), f"{out}/files", f"{out}/checkpoint")
    query.awaitTermination()
    batches = len([f for f in os.listdir(f"{out}/checkpoint/commits") if f.isdigit()])
    found = read_batches(spark, f"{out}/files")
    return found.select("path", "source_url", "file_size", "file_modified", "source_plugin"), batches


def test_discover_stream_lists_in_tasks_what_sparks_file_stream_lists(spark, tmp_path):
    root, out = str(tmp_path / "in"), work_dir(spark, "discover")
    for i in range(30):
        put(root, f"{i % 3}/deep er/%20 {i}.txt")
    put(root, ".hidden"), put(root, "_hidden/a.txt"), put(root, "_a=1/b.txt"), put(root, "empty", ""), put(root, "c._COPYING_")
    put(str(tmp_path / "linked"), "d.txt")
    os.symlink(str(tmp_path / "linked"), f"{root}/link")
    got, batches = discovered(spark, f"file://{root}", out)
    # A number of files per batch is for Spark's own file stream.
    want, _ = discovered(spark, root, work_dir(spark, "discover"), max_files_per_batch=1000)
    assert rows(got) == rows(want) and got.count() == 32 and batches == 1
    for f in os.listdir(f"{out}/checkpoint/offsets"):
        if f.isdigit():
            with open(f"{out}/checkpoint/offsets/{f}") as log:
                assert json.loads(log.read().splitlines()[-1]).keys() == {"names", "sum"}


def test_discover_stream_goes_by_names(spark, tmp_path):
    root, out = str(tmp_path / "in"), work_dir(spark, "discover")
    put(root, "a.txt"), put(root, "b/c.txt"), put(root, "d.md")
    names = lambda found: [os.path.relpath(r[0], f"file:{root}") for r in rows(found, "path")]
    assert names(discovered(spark, root, out, extensions=[".txt"])[0]) == ["a.txt", "b/c.txt"]
    # Nothing new, a change, a file gone, one with old times: a path is listed once, and nothing new is no batch.
    put(root, "a.txt", "longer")
    assert discovered(spark, root, out, extensions=[".txt"])[1] == 1
    os.remove(f"{root}/b/c.txt")
    os.utime(put(root, "b/e.txt"), (1, 1))
    found, batches = discovered(spark, root, out, extensions=[".txt"])
    assert names(found) == ["a.txt", "b/c.txt", "b/e.txt"] and batches == 2
    put(root, "b/c.txt")
    assert names(discovered(spark, root, out, extensions=[".txt"])[0]) == ["a.txt", "b/c.txt", "b/e.txt"]
