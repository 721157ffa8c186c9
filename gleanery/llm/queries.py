"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact_dedup, html_extract, jaccard_join, mixing, packing, prefix_trie, resampling, sharding, substring
from . import token_count, token_files, toxicity

TOKENIZER = "byte_bpe_50k.json"
SHARDS = [f"shard-{i:03}" for i in range(64)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark, sf_dir):
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).drop("set_hash")


def op3_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), encode_special_tokens=False)


def op4_token_counts(spark, sf_dir):
    return token_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op7_substring_dedup(spark, sf_dir):
    return substring.kept_words(_table(spark, sf_dir, "documents")).drop("kept_text")


def op8_toxicity(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_extraction(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_vector_search(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_resampling(spark, sf_dir):
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_token_files(spark, sf_dir):
    return token_files.token_round_trip(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_near_duplicates, op3_packing, op4_token_counts, op5_mixing, op6_sharding, op7_substring_dedup, op8_toxicity, op9_html_extraction, op10_vector_search, op11_resampling, op12_prefix_trie, op13_token_files)}

# CRC-32 of a blob: the table of the reflected polynomial, then byte by byte.
_CRC = r"""
        crc AS MATERIALIZED (
            SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)
                        ORDER BY i) AS steps
            FROM range(256) r(i))"""


def _crc32(blob: str) -> str:
    bytes_of = f"list_transform(range(1, octet_length({blob}) + 1), lambda i: ('0x' || substr(hex({blob}), 2 * i - 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({bytes_of}, lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1]), 4294967295))"


ORACLE = {
    "op11_resampling": rf"""
        WITH {_CRC},
        words AS (
            SELECT 0 AS target, row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
            UNION ALL
            SELECT 1, row_number() OVER (), NULL,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
            FROM benchmark),
        grams AS (SELECT target, rid, unnest(w) AS gram FROM words),
        named AS (
            SELECT gram, {_crc32("encode(gram)")} % 10000 AS bucket
            FROM (SELECT DISTINCT gram FROM grams), crc),
        counts AS (
            SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t
            FROM grams JOIN named USING (gram) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((sum(s) OVER ()) + 10000)::DOUBLE)
                                           / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM counts),
        weights AS (
            SELECT rid, sum(gain)::BIGINT AS weight
            FROM grams JOIN named USING (gram) JOIN gains USING (bucket) WHERE target = 0 GROUP BY rid),
        scored AS (
            SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   (coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln(
                       (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE)
                       / 4294967296::DOUBLE))))::BIGINT AS score
            FROM words LEFT JOIN weights USING (rid) WHERE target = 0)
        SELECT *, CASE WHEN n_features >= 20
                        AND row_number() OVER w <= 10 * (count(*) FILTER (n_features >= 20) OVER ()) // 100
                       THEN row_number() OVER w END AS rank
        FROM scored WINDOW w AS (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST)""",
    "op12_prefix_trie": rf"""
        WITH {_CRC},
        turns AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, turn
            FROM conversations WHERE conv_id IS NOT NULL),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha) AS nth FROM turns),
        convs AS (
            SELECT conv_id, base, {_crc32("encode(conv_id::VARCHAR)")} % 4 AS h
            FROM (SELECT DISTINCT conv_id, base FROM turns), crc),
        taken AS (
            SELECT c.conv_id, 0 AS own, nth, role, text FROM convs c JOIN numbered t ON t.conv_id = c.base WHERE nth <= h
            UNION ALL
            SELECT c.conv_id, 1, nth, role, text FROM convs c JOIN numbered t ON t.conv_id = c.conv_id WHERE nth > h),
        paths AS (
            SELECT conv_id, coalesce(list(struct_pack(role, text) ORDER BY own, nth) FILTER (role IS NOT NULL), []) AS p
            FROM convs LEFT JOIN taken USING (conv_id) GROUP BY conv_id),
        members AS (SELECT conv_id AS member, p, unnest(range(0, len(p) + 1)) AS depth FROM paths),
        nodes AS (
            SELECT list_slice(p, 1, depth) AS prefix, depth, min(member) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (len(p) = depth), '') AS ends
            FROM members GROUP BY ALL),
        children AS (
            SELECT list_slice(prefix, 1, depth - 1) AS prefix, depth - 1 AS depth, count(*) AS n
            FROM nodes WHERE depth > 0 GROUP BY ALL),
        known AS (
            SELECT n.*, coalesce(c.n, 0) AS n_children, u.conv_id AS parent_conv_id,
                   (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE
                       len(regexp_extract_all(n.prefix[n.depth].text, '[^ 	-]+')) END AS saved
            FROM nodes n LEFT JOIN children c USING (prefix, depth)
            LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.prefix = list_slice(n.prefix, 1, n.depth - 1)),
        below AS (
            SELECT x.conv_id, x.depth, count(*) FILTER (y.n_children = 0) AS n_leaves, sum(y.saved) AS saved_tokens
            FROM known x JOIN members m ON m.depth = x.depth AND list_slice(m.p, 1, m.depth) = x.prefix
            JOIN known y ON y.conv_id = m.member AND y.depth >= x.depth
            GROUP BY ALL)
        SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves,
               saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
        FROM known JOIN below USING (conv_id, depth)""",
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
    "op10_vector_search": r"""
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
              AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        p AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                   list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS score
            FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
        FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 20""",
    "op2_near_duplicates": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
            FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
        p AS (
            SELECT a.rid AS a, b.rid AS b, count(*) AS shared
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY ALL),
        l AS (
            SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b
            WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        r AS (SELECT rid, rid AS found FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.found)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM d LEFT JOIN n USING (rid)
        JOIN (SELECT r.rid, min(e.doc_id) AS component_id FROM r JOIN d e ON e.rid = r.found GROUP BY r.rid) c
          ON c.rid = d.rid""",
    "op7_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        x AS (
            SELECT rid, i, array_to_string(list_slice(w, i, i + 34), ' ') AS words
            FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY words) AS n FROM x) WHERE n > 1),
        g AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM h),
        k AS (
            SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
            FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN g USING (rid, i)
            GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (rid)""",
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':42'), 1, 15))::BIGINT AS key
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
            FROM d GROUP BY source),
        f AS (SELECT *, (source_size * 2)::DOUBLE AS cap, (source_size * 2)::DOUBLE / weight AS full_at FROM s),
        l AS (
            SELECT *, row_number() OVER w AS nth,
                   (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                     - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / (sum(weight) OVER ()
                     - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM f WINDOW w AS (ORDER BY full_at, source NULLS LAST)),
        t AS (
            SELECT source, source_size,
                   least(cap, weight * (SELECT arg_min(level, nth) FROM l WHERE level <= full_at)) AS target
            FROM l),
        p AS (
            SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (CASE WHEN source_size > 0
                     THEN (budget // source_size) * size
                          + greatest(0, least(budget % source_size - start, size))
                     ELSE 0 END)::BIGINT AS taken
        FROM p""",
}
