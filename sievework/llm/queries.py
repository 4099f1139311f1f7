"""The query opN_<name> of each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, jaccard, line_dedup, lz_fingerprint, mixing, pseudo_likelihood, quality, sharding, unigram_counts, warc, whitening

SPACES_SQL = r"[\x20\x09-\x0D]+"
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = lz_fingerprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prints.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.get("slots", 0).alias("first_slot"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = unigram_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), scores)


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("deduped_text", 256).alias("deduped_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 8)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_lz_fingerprint, op3_quality, op4_ngram_join, op5_mixing, op6_byte_bpe, op7_token_counts, op8_pseudo_likelihood, op9_warc, op10_line_dedup, op11_whitening, op12_sharding, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": rf"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES_SQL}', ' ', 'g') AS norm FROM documents),
            g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
        "op5_mixing": rf"""
            WITH t AS (
                SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}')) AS size FROM documents),
            s AS (
                SELECT source, sum(size) AS source_size,
                    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
                FROM t GROUP BY source),
            r AS (
                SELECT *, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS total,
                    coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
                    sum(w) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
                FROM s),
            f AS (SELECT (total - stopped) / rest AS level FROM r WHERE (total - stopped) / rest <= ratio ORDER BY ratio, source LIMIT 1),
            g AS (
                SELECT doc_id, t.source, size, source_size, least(2.0 * source_size, level * w) AS target,
                    sum(size) OVER (PARTITION BY t.source ORDER BY ('0x' || substr(md5('mix:' || doc_id), 1, 10))::BIGINT, doc_id) - size AS start
                FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source, f),
            h AS (SELECT doc_id, source, size, CAST(source_size AS BIGINT) AS source_size, target, start, CAST(round(target) AS BIGINT) AS goal,
                CAST(greatest(0, least(size, round(target) - start)) + greatest(0, least(size, round(target) - source_size - start)) AS BIGINT) AS taken FROM g),
            n AS (
                SELECT *, sum(needs) OVER (ORDER BY source NULLS LAST) - needs AS before, sum(needs) OVER () AS total FROM (
                    SELECT DISTINCT source, source_size, goal, (source_size + 1023) // 1024 AS blocks,
                        goal // source_size * ((source_size + 1023) // 1024) + (goal % source_size + 1023) // 1024 AS needs FROM h WHERE goal > 0)),
            q AS (SELECT j AS slot, (j * 2654435769) % 4294967296 / 4294967296.0::DOUBLE AS point FROM (SELECT unnest(range(coalesce(sum(needs), 0)::BIGINT)) AS j FROM n)),
            k AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM q JOIN n ON point >= before::DOUBLE / total AND point < (before + needs)::DOUBLE / total),
            c AS (SELECT source, total + row_number() OVER (ORDER BY source NULLS LAST, rank) - 1 AS slot, rank FROM (
                SELECT n.source, total, unnest(range(coalesce(had, 0), needs::BIGINT)) AS rank FROM n LEFT JOIN (SELECT source, count(*) AS had FROM k GROUP BY source) d ON n.source IS NOT DISTINCT FROM d.source)),
            b AS (
                SELECT n.source, slot, rank % blocks * 1024 AS low, least(rank % blocks * 1024 + 1024, source_size, goal - rank // blocks * source_size) AS high
                FROM (FROM k UNION ALL FROM c) a JOIN n ON a.source IS NOT DISTINCT FROM n.source WHERE rank < needs),
            f1 AS (SELECT doc_id, min(slot)::BIGINT AS first_slot FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source AND start < high AND start + size > low AND size > 0 GROUP BY doc_id)
            SELECT doc_id, source, size, source_size, target, taken, first_slot FROM h LEFT JOIN f1 USING (doc_id)""",
        "op9_warc": """
            WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
            g AS (SELECT hex, max(page_id) AS newest FROM t GROUP BY hex)
            SELECT page_id, payload_bytes,
                array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
                CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> newest THEN newest END AS refers_to
            FROM t JOIN g USING (hex)""",
        "op10_line_dedup": r"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
            w AS (
                SELECT doc_id, i AS place, array_to_string(lines[i + 1:i + 3], chr(10)) AS body
                FROM (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS i FROM d WHERE len(lines) >= 3)),
            v AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) AS nth FROM w
                WHERE trim(replace(replace(replace(body, chr(10), ' '), chr(13), ' '), chr(9), ' ')) <> ''),
            c AS (SELECT DISTINCT doc_id, unnest([place, place + 1, place + 2]) AS line FROM v WHERE nth > 1),
            k AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id),
            j AS (SELECT d.doc_id, lines, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (doc_id))
            SELECT doc_id, len(lines) AS n_lines, len(gone) AS n_removed,
                sha256(coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)), '')) AS deduped_sha256
            FROM j""",
        "op12_sharding": """
            WITH RECURSIVE bits AS (
                SELECT b AS byte, 0 AS done, b AS value FROM (SELECT unnest(range(256)) AS b)
                UNION ALL SELECT byte, done + 1, CASE value & 1 WHEN 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END FROM bits WHERE done < 8),
            crc AS MATERIALIZED (SELECT list(value ORDER BY byte) AS steps FROM bits WHERE done = 8),
            t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(octet_length(encode(text)), 0) + 1 AS size FROM documents),
            b AS (SELECT doc_id, size, list_transform(string_split(text, ''), lambda c: ord(c)) AS points FROM t WHERE text <> ''),
            u AS (SELECT doc_id, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] WHEN p < 2048 THEN [192 | (p >> 6), 128 | (p & 63)]
                WHEN p < 65536 THEN [224 | (p >> 12), 128 | ((p >> 6) & 63), 128 | (p & 63)] ELSE [240 | (p >> 18), 128 | ((p >> 12) & 63), 128 | ((p >> 6) & 63), 128 | (p & 63)] END)) AS bytes FROM b),
            k AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM u, crc),
            r AS (SELECT doc_id, shard, -ln((('0x' || substr(md5(shard || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) AS time FROM t, (SELECT unnest(range(9)) AS shard)),
            a AS (SELECT doc_id, arg_min(shard, time) FILTER (shard < 8) AS shard, arg_min(shard, time) AS grown_shard FROM r GROUP BY doc_id)
            SELECT doc_id, size, coalesce(text_crc32, 0) AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
            FROM t LEFT JOIN k USING (doc_id) JOIN a USING (doc_id)""",
        "op13_filter_audit": rf"""
            WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
            c AS (SELECT *, regexp_extract_all(text, '{WORD_SQL}') AS words, doc_id > min(doc_id) OVER (PARTITION BY text) AS copy FROM t),
            m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * copy::INT AS fails FROM c),
            s AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN labels USING (doc_id) GROUP BY part, fails),
            l AS (SELECT i, chr(65 + i) AS letter, 1 << i AS own FROM (SELECT unnest(range(5))::INT AS i)),
            o AS (SELECT [a.own, b.own, c.own, d.own, e.own] AS bits, concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order FROM l a, l b, l c, l d, l e
                WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
            p AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step))
            SELECT part, filter_order, step, sum(CASE WHEN fails & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails & own > 0 AND fails & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN fails & own > 0 AND fails & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost, sum(CASE WHEN fails & own > 0 THEN n * 120 // bit_count(fails) ELSE 0 END)::BIGINT AS shapley
            FROM s, p GROUP BY part, filter_order, step""",
    }
