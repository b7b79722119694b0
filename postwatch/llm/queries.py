"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postwatch.llm import bpe, common, decontaminate, hard_negatives, lexical, maxent, minhash, near_dedup, phrases, pii, quality, substrings, token_counts, warc

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _queries[build.__name__] = lambda spark, sf_dir: build(common.configure(spark), sf_dir)
    return build


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def further_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Second queries of an operator that has one already."""
    return {"op2_near_copies": lambda spark, sf_dir: minhash.near_copies(table(common.configure(spark), sf_dir, "documents"))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edits(table(spark, sf_dir, "documents"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.find(documents, pii.fit(documents))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.scores(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query
def op9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", own), F.col("vec_id") % 100 == 0)


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


_ORACLES = {
    "op12_lexical": r"""
        WITH split AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM split WHERE len(w) > 0),
        lengths AS (SELECT r, doc_id, len(w)::BIGINT AS n, 25 + (75 * len(w)::BIGINT * n_docs) // n_terms AS m FROM split, totals WHERE len(w) > 0),
        item_terms AS (
            SELECT item, item_id, term, count(*) AS times FROM (
                SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
            ) GROUP BY ALL
        ), postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM split) SEMI JOIN item_terms USING (term) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
            FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
        scores AS (
            SELECT item, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM item_terms JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r) GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10
    """,
    "op11_hard_negatives": r"""
        WITH given AS (
            SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        ), cells AS (
            SELECT r, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM given
        ), refused AS (SELECT DISTINCT r FROM cells WHERE x IS NULL OR NOT isfinite(x)),
        whole AS (SELECT r, j, floor(256 * x)::BIGINT AS x FROM cells ANTI JOIN refused USING (r)),
        rows AS (SELECT vec_id, r, label FROM given ANTI JOIN refused USING (r)),
        scores AS (
            SELECT a.r AS a, c.r AS c, sum(a.x * c.x)::BIGINT AS score
            FROM whole a JOIN (SELECT r FROM rows WHERE vec_id % 100 = 0) USING (r) JOIN whole c ON a.j = c.j GROUP BY 1, 2
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, a.r AS anchor, a.label AS own, c.vec_id AS id, c.r AS r, c.label AS label, score
            FROM scores JOIN rows a ON a.r = scores.a JOIN rows c ON c.r = scores.c WHERE a.r <> c.r
        ), positives AS (
            SELECT anchor, anchor_id, id AS positive_id, score AS positive_score,
                row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS FIRST, r) AS nth FROM pairs WHERE own = label
        )
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, nth ORDER BY score DESC, id NULLS FIRST, r)::INTEGER AS rank,
            id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN pairs n ON n.anchor = p.anchor AND n.own <> n.label
        WHERE nth <= 5 AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
    "op5_decontaminate": r"""
        WITH folded AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), item_windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT k FROM item_windows),
        places AS (
            SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
            FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM folded, sizes WHERE len(w) >= k)
        ), found AS (SELECT r, i, p.k, item_id FROM places p JOIN item_windows v ON p.win = v.win AND p.k = v.k),
        hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM folded LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
    """,
    "op8_warc": r"""
        WITH rows AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (
            SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to
        FROM rows LEFT JOIN firsts USING (payload_digest)
    """,
    "op9_phrases": r"""
        WITH split AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), places AS (
            SELECT doc_id, r, i, array_to_string(w[i : i + 12], ' ') AS win
            FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)
        ), firsts AS (SELECT md5(win) AS h, min(doc_id) AS first FROM places GROUP BY h),
        gone AS (
            SELECT DISTINCT r, unnest(range(i, i + 13)) AS j
            FROM (SELECT r, i FROM places JOIN firsts ON md5(win) = h AND first < doc_id)
        ), kept AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS body
            FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM split) ANTI JOIN gone USING (r, j) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (r)
    """,
}
