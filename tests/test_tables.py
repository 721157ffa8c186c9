"""Items, state, cache: operators and the tables that keep them."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanery.functions import metadata
from gleanery.operators import cache as ca, items as it, joins, state as st
from gleanery.operators.joins import heavy_keys, join_unique
from gleanery.session import work_dir


def make_items(spark, data):
    df = spark.createDataFrame(data, "item_id string, insert_seq long, source_url string, content_hash string")
    df = df.withColumns(
        {"content_type": F.lit("string"), "title": F.col("item_id"), "location": F.concat(F.lit("loc-"), "item_id")}
    )
    return metadata.with_defaults(df)


THREE = [("i1", 1, "test://example.com", "h1"), ("i2", 2, "test://other.com", "h2"), ("i3", 3, "test://example.com", "h1")]


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "item_id string")


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source_url string")


def test_first_match(spark):
    items = make_items(spark, [("z", 1, "u", "h"), ("a", 2, "u", "h"), ("b", 2, "v", "h"), ("c", 2, "v", "h")])
    assert rows(it.first_item_per_url(items)) == [("u", "z"), ("v", "b")]
    probes = spark.createDataFrame([(1, "u"), (2, "u"), (3, "none"), (4, None)], "n int, source_url string")
    assert rows(it.find_item_id(probes, items, "n"), "n", "item_id") == [(1, "z"), (2, "z"), (3, None), (4, None)]


def test_skip_existing(spark):
    items = make_items(spark, THREE)
    found = spark.createDataFrame([(1, "test://other.com"), (2, "new"), (3, "new"), (4, None)], "n int, source_url string")
    for spread in (None, "n"):
        assert rows(it.skip_existing(found, items, spread), "n") == [(2,), (3,), (4,)]


def test_updates(spark):
    items = make_items(spark, THREE)
    u = spark.createDataFrame([("i1", "new", "blob"), ("zz", "x", "blob")], "item_id string, content_hash string, content_type string")
    assert rows(it.update_items(items, u), "item_id", "content_hash", "content_type") == [
        ("i1", "new", "blob"), ("i2", "h2", "string"), ("i3", "h1", "string"),
    ]
    m = metadata.with_defaults(spark.createDataFrame([("i1", "moved")], "item_id string, source_url string"))
    got = it.update_metadata(items, m)
    assert got.columns == items.columns
    # All metadata is replaced, so the title is gone.
    assert rows(got, "item_id", "source_url", "title")[0] == ("i1", "moved", None)


def test_removal(spark):
    items = make_items(spark, THREE)
    left, removed = it.remove_by_url(items, urls(spark, "test://example.com", "none"))
    assert rows(left, "item_id") == [("i2",)]
    assert rows(removed) == [("i1", "cache_i1", "loc-i1"), ("i3", "cache_i3", "loc-i3")]
    left, removed = it.remove_item(items, ids(spark, "i2", "i2", "zz"))
    assert rows(left, "item_id") == [("i1",), ("i3",)]
    assert rows(removed, "cache_id") == [("cache_i2",)]


def test_duplicates(spark):
    items = make_items(spark, THREE)
    assert rows(it.duplicate_groups(items)) == [("h1", 2, "i1")]
    assert rows(it.dedup_by_hash(items), "content_hash", "item_id", "title", "copies") == [("h1", "i1", "i1", 2), ("h2", "i2", "i2", 1)]


@pytest.mark.parametrize("width", [1, 7, 1000, 1 << 20])
def test_item_ids(spark, width):
    values = [-50, -1, 0, 1, 6, 7, 8, 13, 14, 5000, 10**9, 10**13]
    df = spark.createDataFrame([(v,) for v in values], "insert_seq long").repartition(5)
    got = it.item_ids(df, bucket_rows=width)
    assert [r.item_id for r in got.orderBy("insert_seq").collect()] == [f"item_{i}" for i in range(1, 13)]


def test_items_table(spark):
    table = it.ItemsTable(spark, work_dir(spark, "items"))
    assert table.read().count() == 0
    table.append(make_items(spark, THREE), 1)
    table.append(make_items(spark, THREE), 1)
    assert table.read().count() == 3
    table.append(make_items(spark, [("i4", 4, "late", "h2")]), 2)

    u = spark.createDataFrame([("i2", "n1", "blob"), ("later", "x", "blob")], "item_id string, content_hash string, content_type string")
    table.update_items(u, 1)
    table.update_items(u.limit(1).withColumn("content_hash", F.lit("n2")), 2)
    table.update_metadata(metadata.with_defaults(spark.createDataFrame([("i4", "moved")], "item_id string, source_url string")), 3)
    assert rows(table.read(), "item_id", "content_hash", "content_type", "source_url") == [
        ("i1", "h1", "string", "test://example.com"), ("i2", "n2", "blob", "test://other.com"),
        ("i3", "h1", "string", "test://example.com"), ("i4", "h2", "string", "moved"),
    ]
    assert rows(table.remove_by_url(urls(spark, "test://example.com"), 4), "cache_id") == [("cache_i1",), ("cache_i3",)]
    assert rows(table.remove_item(ids(spark, "i2", "i1", "zz"), 5), "item_id") == [("i2",)]
    assert rows(table.read(), "item_id") == [("i4",)]
    # An item stored after its URL was removed stays.
    table.append(make_items(spark, [("i5", 5, "test://example.com", "h")]), 3)
    assert rows(table.read(), "item_id") == [("i4",), ("i5",)]
    one = table.item("i5")
    assert rows(one, "source_url") == [("test://example.com",)] and table.item("i1").count() == 0
    assert "EqualTo(item_id,i5)" in one._jdf.queryExecution().executedPlan().toString()
    assert rows(table.with_hash("h2"), "item_id") == [("i4",)]
    fresh = table.compact_to(work_dir(spark, "items"))
    assert rows(fresh.read()) == rows(table.read())


def test_join_unique_with_one_heavy_key(spark, monkeypatch):
    """A third of the rows has one key, another part has none; all kinds of join agree."""
    monkeypatch.setattr(joins, "HEAVY_ROWS", 500)
    left = spark.range(30_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 7000).cast("string"))).alias("k"),
        (F.col("id") % 2).alias("p"),
    )
    right = spark.createDataFrame([("hot", 0, 1), ("hot", 1, 2), (None, 0, 3)], "k string, p long, v long").unionByName(
        spark.range(0, 7000, 3).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), (F.col("id") % 2).alias("p"), "id").withColumnRenamed("id", "v")
    )
    heavy = {tuple(r) for r in heavy_keys(left, ["k", "p"]).collect()}
    assert heavy == {("hot", 0), ("hot", 1), (None, 0), (None, 1)}
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = join_unique(left, right, ["k", "p"], how, "id")
        want = left.join(right, ["k", "p"], how)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, how


def test_small_sides_are_counted_before_they_are_broadcast(spark, monkeypatch):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    table = spark.range(1000).select("id", F.concat(F.lit("k"), (F.col("id") % 100).cast("string")).alias("k"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = table.join(joins.light(keys), "k", "left_semi")
    assert "BroadcastHashJoin" in plan(small)
    assert joins.only_matching(table, keys, "k").count() == small.count() == 500
    for limit in ("BROADCAST_ROWS", "BROADCAST_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(joins, limit, 49)
            assert not joins.is_small(keys)
            large = table.join(joins.light(keys), "k", "left_semi")
            assert "SortMergeJoin" in plan(large) and large.count() == 500
            assert joins.only_matching(table, keys, "k").count() == 1000
    assert joins.is_small(keys.filter("false"))


def test_operators_agree_whichever_way_they_join(spark, monkeypatch):
    def everything():
        items = make_items(spark, THREE)
        probes = spark.createDataFrame([(1, "test://example.com"), (2, "none")], "n int, source_url string")
        left, removed = it.remove_by_url(items, urls(spark, "test://example.com"))
        return [
            rows(it.find_item_id(probes, items, "n"), "n", "item_id"), rows(it.skip_existing(probes, items), "n"),
            rows(it.skip_existing(probes, items, "n"), "n"), rows(left, "item_id"), rows(removed, "item_id"),
            rows(it.find_item(items, ids(spark, "i1", "zz")), "item_id"),
        ]

    before = everything()
    assert before == [[(1, "i1"), (2, None)], [(2,)], [(2,)], [("i2",)], [("i1",), ("i3",)], [("i1",)]]
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "HEAVY_ROWS", 0)
    assert everything() == before


def test_heavy_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(8000).select("id", F.lit("hot").alias("k"))
        right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
        sizes = (
            join_unique(left, right, "k", "inner", "id")
            .groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in sizes) == 8000
    assert max(r["count"] for r in sizes) < 5000


LOG = "partition_key string, key string, value_json string, version int, seq long"


def test_state_operators(spark):
    log = spark.createDataFrame(
        [
            ("p", "k1", "1", 1, 1), ("p", "k1", "2", 2, 2), ("p", "k2", '"x"', 5, 3), ("p", "k2", '"y"', 1, 4),
            ("p", "k3", "null", 3, 5), ("q", "k1", "1", 9, 6), ("p", "k4", "1.0", 2, 7), ("p", "k5", "2", 4, 8),
        ],
        LOG,
    )
    latest = st.state_latest(log)
    assert rows(latest.filter("partition_key = 'p'"), "key", "value_json", "version") == [
        ("k1", "2", 2), ("k2", '"y"', 1), ("k3", "null", 3), ("k4", "1.0", 2), ("k5", "2", 4),
    ]
    assert [tuple(r) for r in st.state_older_than(latest, "p", 3).collect()] == [("k2", '"y"', 1), ("k1", "2", 2), ("k4", "1.0", 2)]
    assert rows(st.state_keys_with_value(latest, "p", "2")) == [("k1",), ("k5",)]
    assert rows(st.state_keys_with_value(latest, "p", "1")) == []
    asked = spark.createDataFrame(
        [(1, "p", "k3", '"d"'), (2, "p", "none", '"d"'), (3, "q", "k2", None), (4, "p", "k1", None)],
        "n int, partition_key string, key string, default_json string",
    )
    assert rows(st.state_get(latest, asked, "n"), "n", "value_json", "found") == [
        (1, "null", True), (2, '"d"', False), (3, None, False), (4, "2", True),
    ]
    gone = st.state_delete(spark.createDataFrame([("p", "k1", 10)], "partition_key string, key string, seq long"))
    after = st.state_latest(log.unionByName(gone))
    assert dict(rows(st.state_exists(after).filter("partition_key = 'p'"), "key", "exists")) == {
        "k1": False, "k2": True, "k3": False, "k4": True, "k5": True,
    }


def test_state_table(spark):
    table = st.StateTable(spark, work_dir(spark, "state"))
    assert table.latest().count() == 0
    entry = lambda v, *more: spark.createDataFrame([("k", v, 1, *more)], "key string, value_json string, seq long" + (", version int" if more else ""))
    a, b = table.partition("a"), table.partition("b")
    a.store(entry("1", 5), 1)
    b.store(entry("2"), 2)
    assert rows(a.latest(), "value_json", "version") == [("1", 5)]
    a.store(entry("3"), 3)
    a.store(entry("3"), 3)
    assert rows(table.latest()) == [("a", "k", "3", 1), ("b", "k", "2", 1)]
    assert table.log().count() == 3
    assert rows(a.older_than(2), "key") == [("k",)] and rows(b.keys_with_value("3")) == []
    assert rows(table.compact_to(work_dir(spark, "state")).latest()) == rows(table.latest())


def test_state_scan_is_pruned(spark):
    table = st.StateTable(spark, work_dir(spark, "state"))
    table.store(spark.createDataFrame([("a", "k", "1", 1, 1), ("b", "k", "1", 1, 1)], LOG), 0)
    plan = table.latest("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_key" in plan


def test_cache(spark):
    table = ca.CacheTable(spark, work_dir(spark, "cache"))
    content = spark.createDataFrame(
        [("p", ".txt", "u1", "text", None), ("p", "", "u2", None, bytearray(b"\xff")), ("q", ".md", "u3", "more", None)],
        "partition_key string, file_extension string, unique_id string, content_text string, content_binary binary",
    )
    assert rows(table.save(content, 1), "cache_id") == [("p|.txt|u1|0",), ("p||u2|1",), ("q|.md|u3|0",)]
    assert rows(table.partition("q").list()) == [("q|.md|u3|0",)]
    assert rows(table.list("p")) == [("p|.txt|u1|0",), ("p||u2|1",)] and rows(table.list("none")) == []
    wanted = spark.createDataFrame([("p||u2|1",), ("q|.md|u3|0",), ("p|.md|u3|0",), ("bad",)], "cache_id string")
    got = {r.cache_id: r.content_text or bytes(r.content_binary) for r in table.get(wanted).collect()}
    assert got == {"p||u2|1": b"\xff", "q|.md|u3|0": "more"}
    gone = spark.createDataFrame([("p|.txt|u1|0",), ("missing",), ("p|.txt|u1|0",)], "cache_id string")
    assert rows(table.remove_all(gone, 1)) == [("p|.txt|u1|0",)]
    assert rows(table.remove_all(gone, 2)) == []
    items = make_items(spark, THREE).withColumn("location", F.when(F.col("item_id") != "i2", F.lit("p||u2|1")))
    assert rows(table.remove_orphans(items, 3)) == [("q|.md|u3|0",)]
    assert rows(table.read(), "cache_id") == [("p||u2|1",)]
    assert rows(table.compact_to(work_dir(spark, "cache")).read(), "cache_id") == [("p||u2|1",)]


def test_removed_items_lead_to_their_cached_content(spark):
    cache = ca.CacheTable(spark, work_dir(spark, "cache"))
    content = spark.createDataFrame([("u1", "one"), ("u2", "two"), ("u3", "three")], "unique_id string, content_text string")
    cache.partition("p").save(content.withColumn("file_extension", F.lit(".txt")), 1)
    items = it.ItemsTable(spark, work_dir(spark, "items"))
    stored = make_items(spark, THREE).withColumn(
        "location", F.concat(F.lit("p|.txt|u"), F.substring("item_id", 2, 1), F.lit("|0"))
    )
    items.append(stored, 1)
    removed = items.remove_by_url(urls(spark, "test://example.com"), 2)
    gone = cache.partition("p").remove_all(removed.select(F.col("location").alias("cache_id")), 1)
    assert rows(gone) == [("p|.txt|u1|0",), ("p|.txt|u3|0",)]
    assert rows(cache.list("p")) == [("p|.txt|u2|0",)]
    assert rows(items.urls()) == [("test://other.com",)]


def test_stored_items_have_bloom_filters(spark):
    import duckdb

    table = it.ItemsTable(spark, work_dir(spark, "items"))
    table.append(make_items(spark, THREE), 1)
    root = table.root.removeprefix("file:")
    found = duckdb.sql(
        f"select distinct path_in_schema from parquet_metadata('{root}/rows/writer=w-main/batch_id=1/*/*.parquet') "
        "where bloom_filter_length is not null"
    ).fetchall()
    assert {c for c, in found} == set(it.LOOK_UP_BY)
