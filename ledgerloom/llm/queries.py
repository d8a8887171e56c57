"""The registered queries of the training-data operators, at production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, exact_dedup, language_id, line_dedup, mixing, sentencepiece_codec, sharding, similarity_join, token_alignment, token_counts, token_files, topk_search, whitening
from .common import documents, scratch

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encode_pieces(documents(spark, sf_dir), public_tokenizers.path(PIECES))
    return found.select("doc_id", "n_tokens", "token_ids", "round_trip")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES), limit=4096)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.similar_documents(documents(spark, sf_dir), percent=75, width=5).select("doc_id", "n_shingles", "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify_languages(docs, language_id.training_samples(docs))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved_shards(documents(spark, sf_dir), shards=8)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path(BYTES), folder, end_id=0)
    return token_files.read_token_files(spark, folder)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir), weights=(1, 2, 3))


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir), percent=85, width=5).select("doc_id", "n_shingles", "component_id", "kept")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(documents(spark, sf_dir), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_token_counts,
        op3_topk_search,
        op4_similarity_join,
        op5_language_id,
        op6_sharding,
        op7_exact_dedup,
        op8_token_files,
        op9_line_dedup,
        op10_mixing,
        op11_chosen_path,
        op12_whitening,
        op13_alignment,
    )
}

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _components_sql(percent: int) -> str:
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
            FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common WHERE 100 * c >= {percent} * (na + nb - c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT DISTINCT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.least, s.doc_id) AS component_id
        FROM sets s LEFT JOIN (SELECT node, min(seen) AS least FROM reach GROUP BY node) m ON m.node = s.doc_id"""


# One byte of a CRC-32, in two steps of four bits. The remainders of the four-bit numbers.
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_HALF = f"xor(xor(a, b) >> 4, ({_NIBBLES})[(xor(a, b) & 15) + 1])"
_CRC_STEP = f"xor({_HALF} >> 4, ({_NIBBLES})[({_HALF} & 15) + 1])"

ORACLES: dict[str, str] = {
    "op3_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op4_similarity_join": _components_sql(75),
    "op11_chosen_path": f"SELECT *, component_id = doc_id AS kept FROM ({_components_sql(85)})",
    "op6_sharding": f"""
        WITH d AS (
            SELECT doc_id, source, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
                md5(concat_ws(':', 'shard-1', coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) AS key FROM documents),
        c AS (
            SELECT doc_id, source, size, key, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
                list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT)), lambda a, b: {_CRC_STEP})) AS text_crc32 FROM d),
        f AS (
            SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM c),
        p AS (SELECT *, row_number() OVER (ORDER BY fraction, key, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM f)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 8 // total)::INTEGER AS shard,
            (place - (place * 8 // total * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
        FROM p""",
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY norm) AS group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op9_line_dedup": r"""
        WITH p AS (
            SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '') AS host,
                regexp_replace(regexp_replace(regexp_replace(html, '%s', chr(10), 'g'), '%s', chr(10), 'g'), '%s', '', 'g') AS t
            FROM pages),
        l AS (
            SELECT page_id, host, list_filter(list_transform(coalesce(regexp_split_to_array(t, '\r?\n'), []),
                lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS lines FROM p),
        hosts AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
        frequent AS (
            SELECT u.host, list(u.line) AS bad
            FROM (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY ALL) u
            JOIN hosts h ON h.host IS NOT DISTINCT FROM u.host WHERE n >= 2 AND n > 0.1 * pages GROUP BY u.host)
        SELECT page_id, l.host, len(lines)::BIGINT AS n_lines, (len(lines) - len(k))::BIGINT AS n_dropped, coalesce(array_to_string(k, chr(10)), '') AS text
        FROM (SELECT l.*, list_filter(lines, lambda x: NOT list_contains(coalesce(f.bad, []), x)) AS k
              FROM l LEFT JOIN frequent f ON f.host IS NOT DISTINCT FROM l.host) l"""
    % (line_dedup.UNSEEN, line_dedup.BREAKS, line_dedup.TAGS),
    "op10_mixing": f"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size,
                md5(concat_ws(':', 'mix-1', coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (
            SELECT source, source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1.0::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM s),
        f AS (
            SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER o, 0.0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0.0)) AS level
            FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
            SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM f WHERE level * w <= cap) * w, cap)) AS target FROM f),
        r AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
                sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle,
                CASE WHEN source_size > 0 THEN floor(target / source_size)::INTEGER ELSE 0 END AS passes
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, size * epochs AS taken, epochs, source
        FROM (SELECT *, least(3, passes + (middle <= target - passes * source_size)::INTEGER)::INTEGER AS epochs FROM r)""",
}
