"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import asof_join, bpe, embedding_dedup, exact_dedup, html_text, mixing, near_dedup, pii, prefix_trie, sharding
from lumenfold.llm import substring_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(docs))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 8)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_docs(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, remembered=300_000)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = mixing.rates(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_docs(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join.click_orders(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_embedding_dedup, op3_near_dedup, op4_sharding, op5_bpe, op6_mixing, op7_url_filter,
        op8_substring_dedup, op9_exact_dedup, op10_toxicity, op11_html_text, op12_asof_join,
        op13_prefix_trie, pipeline,
    )
}

#: t: the 256 steps of CRC-32 as a list, for crc_of().
CRC_TABLE = """
        steps AS (
          SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
                   CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
          FROM range(256) r(i)),
        crc AS (SELECT list(c ORDER BY i) AS t FROM steps),"""


def crc_of(number: str) -> str:
    """SQL: the unsigned CRC-32 of a number's decimal digits, where crc is joined."""
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    step = "xor(c >> 8, t[(xor(c, x) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, x: {step}))"


ORACLE_SQL: dict[str, str] = {
    "op13_prefix_trie": f"""
        WITH RECURSIVE {CRC_TABLE}
        turns AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id
                                    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        whole AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
        convs AS (
          SELECT c.conv_id, conv_id - conv_id % 5 AS base, {crc_of("conv_id")} % 9 AS h FROM whole c, crc),
        based AS (
          SELECT c.*, least(h, coalesce(b.n, 0)) AS m FROM convs c LEFT JOIN whole b ON b.conv_id = c.base),
        rebuilt AS (
          SELECT c.conv_id, t.pos AS depth, role, text FROM based c JOIN turns t ON t.conv_id = c.base AND t.pos <= h
          UNION ALL
          SELECT c.conv_id, t.pos - h + m, role, text FROM based c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > h),
        walk AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS depth, min(conv_id) OVER () AS node, CAST(NULL AS BIGINT) AS parent,
                 CAST(0 AS BIGINT) AS bytes
          FROM convs
          UNION ALL
          SELECT w.conv_id, w.depth + 1, min(w.conv_id) OVER (PARTITION BY w.node, role, text), w.node, strlen(text)
          FROM walk w JOIN rebuilt r ON r.conv_id = w.conv_id AND r.depth = w.depth + 1),
        nodes AS (
          SELECT node, depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved
          FROM walk GROUP BY node, depth),
        children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        family AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node, depth)),
        subtree AS (
          SELECT w.node, w.depth, sum(u.saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
          FROM family u JOIN walk w ON w.conv_id = u.node AND w.depth <= u.depth GROUP BY w.node, w.depth),
        last_depth AS (SELECT conv_id, max(depth) AS depth FROM walk GROUP BY conv_id),
        ended AS (
          SELECT node, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
          FROM walk JOIN last_depth USING (conv_id, depth) GROUP BY node, depth)
        SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM family JOIN subtree USING (node, depth) LEFT JOIN ended USING (node, depth)
    """,
    "op12_asof_join": f"""
        WITH {CRC_TABLE}
        looked AS (
          SELECT click_id, client_id, epoch_us(ts) AS us, {crc_of("click_id")} AS h
          FROM clicks, crc
          QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts NULLS LAST, client_id NULLS LAST) = 1),
        looks AS (
          SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - ((us % 3600000000) + 3600000000) % 3600000000
                                           ELSE us END AS ts_us
          FROM looked),
        sold AS (
          SELECT sale_id, client_id, priority, epoch_us(sold_at) AS us, {crc_of("sale_id")} AS h,
                 CASE WHEN abs(total) < 9e16 THEN CAST(floor(100 * total + 0.5) AS BIGINT) END AS total_cents
          FROM sales, crc),
        timed AS (
          SELECT *, CASE WHEN h % 2 = 1 THEN us - ((us % 3600000000) + 3600000000) % 3600000000 ELSE us END AS sold_us
          FROM sold WHERE client_id IS NOT NULL AND us IS NOT NULL),
        every_order AS (
          SELECT client_id, sold_us, sale_id, priority, total_cents FROM timed
          UNION ALL SELECT client_id, sold_us, -1 - sale_id, 6 - priority, total_cents FROM timed WHERE h % 3 <> 0),
        groups AS (
          SELECT client_id, sold_us, sale_id, total_cents, count(*) OVER (PARTITION BY client_id, sold_us) AS n_tied
          FROM every_order
          QUALIFY row_number() OVER (PARTITION BY client_id, sold_us
                                     ORDER BY priority NULLS LAST, sale_id DESC NULLS LAST, total_cents DESC NULLS LAST) = 1)
        SELECT click_id, client_id, ts_us, CASE WHEN near THEN sale_id END AS sale_id,
               CASE WHEN near THEN ts_us - sold_us END AS lag_us, CASE WHEN near THEN total_cents END AS total_cents,
               CASE WHEN near THEN n_tied ELSE 0 END AS n_tied
        FROM (SELECT l.click_id, l.client_id, l.ts_us, g.sold_us, g.sale_id, g.total_cents, g.n_tied,
                     coalesce(l.ts_us - g.sold_us <= 240 * 3600000000, false) AS near
              FROM looks l ASOF LEFT JOIN groups g ON l.client_id = g.client_id AND l.ts_us >= g.sold_us)
    """,
    "op9_exact_dedup": r"""
        WITH squeezed AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
          FROM documents),
        grouped AS (
          SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id
          FROM squeezed)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
    """,
}
