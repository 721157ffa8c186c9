"""Column types of the tables. Metadata fields are plain top-level columns so that
scans prune them and Parquet keeps statistics for each.

`extra_json` is JSON text, not VARIANT: it has to survive grouping and comparison,
which VARIANT does not support. It is parsed where it is looked into.
"""

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("source_url", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("processing_state", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("author", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("mime_type", T.StringType()),
        T.StructField("extra_json", T.StringType()),
    ]
)
METADATA_FIELDS = METADATA.fieldNames()

# One row per listed file.
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("file_modified", T.TimestampType()),
        T.StructField("source_plugin", T.StringType()),
    ]
)

# What Spark's binaryFile source yields; streams have to state it.
BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

ITEMS = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("insert_seq", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("content_type", T.StringType()),
        *METADATA.fields,
    ]
)

STATE_LOG = T.StructType(
    [
        T.StructField("partition_key", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value_json", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

# One row per leaf of a nested record. `path` is an array because names may hold dots.
LEAVES = "path array<string>, kind string, value_json string"
