"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkveil.llm.bpe import round_trip
from inkveil.llm.collocations import collocations
from inkveil.llm.common import table
from inkveil.llm.exact_dedup import exact_groups
from inkveil.llm.maxent_lm import score
from inkveil.llm.near_dedup import near_groups
from inkveil.llm.packing import pack
from inkveil.llm.prefix_trie import prefix_trie
from inkveil.llm.quality import STOP_WORDS, quality
from inkveil.llm.secret_scan import scan
from inkveil.llm.sharding import document_shards
from inkveil.llm.substring_dedup import substring_dedup
from inkveil.llm.url_filter import judge_urls
from inkveil.llm.warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]


def op1_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("span_list")


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).drop("error")


def op6_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(table(spark, sf_dir, "documents"))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(table(spark, sf_dir, "documents")).select(*columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=2)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_cutting_stock_packing": op1_cutting_stock_packing,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc_zstd": op5_warc_zstd,
    "op6_uniform_shards": op6_uniform_shards,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op5_warc_zstd": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        g AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
                     min(page_id) OVER (PARTITION BY body) AS first FROM p),
        b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, 5 * k::INT + 1, 5))::BIGINT) AS v FROM g)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '')
                   AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b""",
    "op9_quality_rules": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
              FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
                     coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                     len(list_filter(ws, lambda w: w IN ({stop}))) AS n_stop
              FROM w LEFT JOIN p USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.3 AND n_stop / n_words >= 0.01
               AND n_dup_lines <= 0.5 * n_lines AS kept
        FROM b""".replace("{stop}", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))),
    "op10_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
        n AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM g),
        f AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM g),
        p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        arcs AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT arcs.b, r.m FROM r JOIN arcs ON arcs.a = r.v),
        c AS (SELECT v, min(m) AS component_id FROM r GROUP BY v)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.v = n.doc_id""",
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(strlen(r)::VARCHAR || ':' || r || x)) AS ts FROM t GROUP BY conv_id),
        b AS (SELECT DISTINCT conv_id, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i:
                     list_transform(range(0, 8), lambda j: (ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT >> j) & 1))) AS bits FROM o),
        h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, k:
                     xor(c >> 1, 3988292384::BIGINT * (xor(c, k) & 1))), 4294967295) % 9 AS h FROM b),
        s AS (SELECT o.conv_id, list_concat(coalesce(f.ts, [])[1:h.h], o.ts[h.h + 1:]) AS ts
              FROM o JOIN h USING (conv_id) LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % 5),
        p AS (SELECT conv_id, unnest(range(0, len(ts) + 1)) AS d, ts FROM s),
        n AS MATERIALIZED (SELECT ts[1:d] AS v, d, min(conv_id) AS conv_id, count(*) AS n_convs,
              sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ts) = d), '')) AS ends_sha256 FROM p GROUP BY ALL),
        k AS (SELECT v[1:d - 1] AS v, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * strlen(n.v[n.d].x) ELSE 0 END AS saved
              FROM n LEFT JOIN k ON k.d = n.d AND k.v = n.v),
        u AS (SELECT v[1:e] AS v, e AS d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
              FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
        SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, m.ends_sha256
        FROM m JOIN u ON u.d = m.d AND u.v = m.v LEFT JOIN m q ON q.d = m.d - 1 AND q.v = m.v[1:m.d - 1]""",
    "op12_substring_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, r, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d)),
        m AS (SELECT r, i FROM g QUALIFY coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY win)),
        c AS (SELECT DISTINCT r, i + k AS i FROM m, (SELECT unnest(range(0, 13)) AS k)),
        w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
        k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN c USING (r, i) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (r)""",
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
        u AS (SELECT lang, ws, count(*) AS times FROM p GROUP BY ALL),
        t AS (SELECT lang, sum(len(ws) * times)::BIGINT AS n FROM u GROUP BY lang),
        x AS (SELECT lang, ws, times, n, unnest(range(1, len(ws) - n + 2)) AS i FROM u, (SELECT unnest([1, 2, 3, 4]) AS n)),
        f AS MATERIALIZED (SELECT lang, ws[i:i + n - 1] AS ws, n, sum(times)::BIGINT AS f FROM x GROUP BY ALL HAVING sum(times) >= 30),
        c AS (SELECT lang, ws, n, f AS a, unnest(range(1, n)) AS k FROM f WHERE n > 1),
        s AS (SELECT c.lang, c.ws, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a::HUGEINT) // (l.f::HUGEINT + r.f) AS score
              FROM c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1:]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
        i AS (SELECT lang, ws[j:j + m - 1] AS ws, max(f) AS longer FROM (SELECT *, unnest(range(1, n - m + 2)) AS j
              FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < n) GROUP BY ALL),
        o AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.ws = b.ws
              WHERE NOT coalesce(100 * longer::HUGEINT >= 80 * a::HUGEINT, false)),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN t USING (lang) WHERE rank <= 2000""",
}
