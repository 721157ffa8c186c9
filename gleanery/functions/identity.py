"""Hashes and ids. Ids are derived from the row, never random: a retried task or a
replayed batch has to produce the same ones."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UUID_LENGTH = 36
UUID_DASHES = 4


def content_hash(text: Column, binary: Column | None = None) -> Column:
    """SHA-256 of the UTF-8 bytes of text, else of the raw bytes."""
    h = F.sha2(text, 256)
    return h if binary is None else F.coalesce(h, F.sha2(binary, 256))


def content_type(text: Column) -> Column:
    return F.when(text.isNotNull(), F.lit("string")).otherwise(F.lit("blob"))


def item_id(source_url: Column, hash_: Column, insert_seq: Column) -> Column:
    return F.sha2(F.concat_ws("|", source_url, hash_, insert_seq.cast("string")), 256)


def uuid_from_md5(md5: Column) -> Column:
    """32 hex digits laid out 8-4-4-4-12."""
    return F.concat_ws(
        "-",
        F.substring(md5, 1, 8),
        F.substring(md5, 9, 4),
        F.substring(md5, 13, 4),
        F.substring(md5, 17, 4),
        F.substring(md5, 21, 12),
    )


def cache_id_encode(
    partition_key: Column, extension: Column, unique_id: Column, is_binary: Column
) -> Column:
    flag = F.when(is_binary, F.lit("1")).otherwise(F.lit("0"))
    return F.concat_ws("|", partition_key, F.coalesce(extension, F.lit("")), unique_id, flag)


def cache_id_decode(cache_id: Column) -> Column:
    """Struct of the four parts; null unless there are exactly four."""
    p = F.split(cache_id, r"\|", -1)
    return F.when(
        F.size(p) == 4,
        F.struct(
            p[0].alias("partition_key"),
            p[1].alias("file_extension"),
            p[2].alias("unique_id"),
            (p[3] == "1").alias("is_binary"),
        ),
    )


def cache_file_name(unique_id: Column, extension: Column, is_binary: Column) -> Column:
    base = F.when(is_binary, F.concat(unique_id, F.lit(".bin"))).otherwise(unique_id)
    ext = F.coalesce(extension, F.lit(""))
    return F.when(base.endswith(ext), base).otherwise(F.concat(base, ext))


def cache_path_decode(relative_path: Column) -> Column:
    """Parts of `<partition>/<uuid>[.bin][ext]`; null for any other shape."""
    p = F.split(relative_path, "/", -1)
    name = F.try_element_at(p, F.lit(2))
    binary = F.contains(name, F.lit(".bin"))
    # Only the first ".bin" is the marker.
    plain = F.when(
        binary, F.concat(F.substring_index(name, ".bin", 1), F.regexp_extract(name, r"(?s)^.*?\.bin(.*)$", 1))
    ).otherwise(name)
    uid = F.substring_index(plain, ".", 1)
    dashes = F.length(uid) - F.length(F.replace(uid, F.lit("-"), F.lit("")))
    ok = (F.size(p) == 2) & (F.length(uid) == UUID_LENGTH) & (dashes == UUID_DASHES)
    return F.when(
        ok,
        F.struct(
            p[0].alias("partition_key"),
            F.regexp_extract(plain, r"(?s)^[^.]*(\..*)$", 1).alias("file_extension"),
            uid.alias("unique_id"),
            binary.alias("is_binary"),
        ),
    )
