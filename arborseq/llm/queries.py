"""The driver's queries on the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed_digest

    return removed_digest(_table(spark, sf_dir, "documents"), depth=100)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2, digest=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_groups

    groups = near_groups(_table(spark, sf_dir, "documents"), shingle=3, seed=42)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"), largest=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), limit=4096)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resampled

    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least_words=20, share=(5, 100), seed=42)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import deduplicated_lines

    out = deduplicated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=10, least_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_suffix_dedup, op3_bpe, op4_quality, op5_language_id, op6_packing, op7_simhash, op8_exact_dedup, op9_token_counts, op10_neighbours, op11_importance, op12_filter_audit, op13_line_dedup, pipeline)
}

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {s}) & 31 AS INTEGER), 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)

_ORDERS = "WITH RECURSIVE o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x))"
#: Bytes to the polynomial's remainder, a table of 256 made from the polynomial.
_CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i)))"
_BUCKET = "xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda x: ('0x' || substr(hex(encode(f)), 2 * x + 1, 2))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h
            FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
        SELECT page_id, payload_bytes, {_B32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
        w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS s FROM d)),
        again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM w) WHERE rn > 1),
        new AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
        numbered AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM new),
        spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 100 AS e FROM numbered GROUP BY doc_id, span),
        pieces AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM spans),
        cut AS (SELECT p.doc_id, sum(e - a) AS removed, count(*) AS n, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept
            FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id""",
    "op8_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM g""",
    "op11_importance": f"""
        WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
        w AS (SELECT doc_id, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
            FROM (SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark)),
        g AS (SELECT doc_id, item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
        c AS (SELECT doc_id, f, count(*) AS n FROM g GROUP BY ALL),
        b AS MATERIALIZED (SELECT f, {_BUCKET} AS b FROM (SELECT DISTINCT f FROM c), crc),
        cb AS MATERIALIZED (SELECT doc_id, b, sum(n) AS n FROM c JOIN b USING (f) GROUP BY ALL),
        k AS (SELECT b, coalesce(sum(n) FILTER (doc_id IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (doc_id IS NULL), 0) AS t FROM cb GROUP BY b),
        a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM k),
        gain AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM k, a),
        e AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM cb JOIN gain USING (b) WHERE doc_id IS NOT NULL GROUP BY doc_id),
        r AS (SELECT w.doc_id, len(w) >= 20 AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
            CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
            FROM w LEFT JOIN e ON e.doc_id = w.doc_id WHERE w.doc_id IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS able_all FROM r)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * able_all // 100 THEN place END AS rank FROM n""",
    "op12_filter_audit": f"""
        {_ORDERS},
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        m AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
            CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
            || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN first < w.doc_id THEN 'E' ELSE '' END AS fails
            FROM w LEFT JOIN labels ON labels.doc_id = w.doc_id),
        cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
        s AS (SELECT part, filter_order, step, filter_order[step] AS f, fails, n, good, toxic, contains(fails, filter_order[step]) AS bad,
            len(list_filter(range(1, step), lambda i: contains(fails, filter_order[i]))) > 0 AS before
            FROM cells, (SELECT * FROM o WHERE len(filter_order) = 5), (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
        a AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT bad AND NOT before) AS kept, sum(n) FILTER (bad AND NOT before) AS removed, sum(n) FILTER (bad AND before) AS redundant,
            sum(n) FILTER (fails = f) AS unique_fails, sum(good) FILTER (bad AND NOT before) AS good_lost, sum(toxic) FILTER (bad AND NOT before) AS toxic_lost FROM s GROUP BY ALL)
        SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
            CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM a""",
    "op13_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        hot AS (SELECT key, true AS hot FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hot) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hot IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN hot USING (key) GROUP BY doc_id""",
}
