"""The test tables seen as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import identity

# Suffix by doc_id % 6.
EXTENSIONS = (".txt", ".md", ".html", ".json", ".rst", ".TXT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_extension() -> F.Column:
    exts = F.array(*[F.lit(e) for e in EXTENSIONS])
    return F.element_at(exts, (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))


def doc_url() -> F.Column:
    return F.concat(
        F.lit("file:///corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), doc_extension()
    )


def fetched_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        doc_url().alias("source_url"),
        F.col("text").alias("content_text"),
        F.col("doc_id").alias("insert_seq"),
        "lang",
        F.col("source").alias("author"),
        "n_chars",
    )


def docs_with_type(spark, sf_dir) -> DataFrame:
    """fetched_docs with the type their suffix stands for."""
    from ..functions import paths

    return fetched_docs(spark, sf_dir).withColumn("mime_type", paths.mime_from_path(F.col("source_url")))


def existing_items(spark, sf_dir) -> DataFrame:
    """Documents that have a label, as stored items; every other one has a cached copy."""
    docs, labels = fetched_docs(spark, sf_dir), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select(
        F.concat(F.lit("item_"), F.col("doc_id").cast("string")).alias("item_id"),
        "insert_seq",
        F.sha2("content_text", 256).alias("content_hash"),
        F.lit("string").alias("content_type"),
        "source_url",
        F.when(F.col("doc_id") % 2 == 0, doc_cache_id()).alias("location"),
        F.lit("extracted").alias("processing_state"),
        "author",
        F.lit("text/plain").alias("mime_type"),
        F.array("author", "lang").alias("tags"),
        F.lit("{}").alias("extra_json"),
    )


def doc_uuid() -> F.Column:
    return identity.uuid_from_md5(F.md5(F.col("doc_id").cast("string")))


def doc_cache_id() -> F.Column:
    source = F.col("author")
    return identity.cache_id_encode(source, F.lit(".txt"), doc_uuid(), F.lit(False))


def cache_content(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("partition_key"),
        F.lit(".txt").alias("file_extension"),
        doc_uuid().alias("unique_id"),
        F.col("text").alias("content_text"),
        "doc_id",
    )


def log_from_events(events: DataFrame) -> DataFrame:
    """Events as state log entries. `seq` follows (ts, event_id)."""
    return events.select(
        F.col("event_type").alias("partition_key"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value_json"),
        F.get_json_object("props", "$.k").cast("int").alias("version"),
        F.struct("ts", "event_id").alias("seq"),
        "ts",
    )


def state_log(spark, sf_dir) -> DataFrame:
    return log_from_events(table(spark, sf_dir, "events"))


# When the two snapshots were taken, and after how many days without an entry a key is dropped from one.
SNAPSHOT_TIMES = ("2024-01-16 00:00:00", "2024-02-01 00:00:00")
IDLE_DAYS = 3


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The state as it was at two times, of the keys that were in use then: each folds the log up to its time, so
    either one has keys that the other does not have."""
    log = state_log(spark, sf_dir)
    kind = log.schema["ts"].dataType

    def taken(when):
        at = F.lit(when).cast(kind)
        latest = F.max_by(F.struct("value_json", "version"), "seq").alias("__v")
        state = log.filter(F.col("ts") < at).groupBy("partition_key", "key").agg(latest, F.max("ts").alias("__last"))
        in_use = state.filter(F.col("__last") >= at - F.expr(f"interval {IDLE_DAYS} days"))
        return in_use.select("partition_key", "key", "__v.value_json", "__v.version")

    return taken(SNAPSHOT_TIMES[0]), taken(SNAPSHOT_TIMES[1])


def item_parents(spark, sf_dir) -> DataFrame:
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", conv, turn.cast("string")).alias("item_id"),
        F.when(turn > 0, F.concat_ws("/", conv, (turn - 1).cast("string"))).alias("parent_id"),
    )
