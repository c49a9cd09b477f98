"""The registered queries of the text operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stocktake.llm import (
    cap_filters,
    context_tree,
    fm_index,
    hypergeometric_shuffle,
    latent_decontamination,
    license_scan,
    lyndon_runs,
    mixture_packing,
    quality_knn,
    simhash_pivots,
    stripes,
    token_cache,
    toxicity_fm,
)
from stocktake.llm.common import load


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, 4 differing bits."""
    return simhash_pivots.near_duplicates(load(spark, sf_dir, "documents"), words=4, max_bits=4)


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return context_tree.scored(load(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, each place by the template it holds most of."""
    return license_scan.scan(load(spark, sf_dir, "documents"), best=True)


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings at cosine 0.95."""
    return cap_filters.near_duplicates(load(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity_fm.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), threshold=0.3)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents through the digest cache."""
    import public_tokenizers
    cache = token_cache.TokenCountCache(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return cache.count(load(spark, sf_dir, "documents"), limit=4096)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return latent_decontamination.decontaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens in their sources' proportions."""
    import public_tokenizers
    return mixture_packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_uniform_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards by a uniform shuffle with exact sizes."""
    return hypergeometric_shuffle.document_shards(load(spark, sf_dir, "documents"), shards=40)


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality_knn.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), threshold=0.7)


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of at least 12 words in all documents."""
    return lyndon_runs.run_digests(load(spark, sf_dir, "documents"), shortest=12)


def op12_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language: phrases of 2 to 5 words that occur 100 times or more."""
    return stripes.collocations(load(spark, sf_dir, "documents"), least=100, most_words=5, percent=100, top=2000)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 13 words or more that a document with a smaller id holds."""
    return fm_index.substring_dedup(load(spark, sf_dir, "documents"), window=13, digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_context_tree": op2_context_tree,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_neardup": op4_embedding_neardup,
    "op5_toxicity_fm": op5_toxicity_fm,
    "op6_token_counts": op6_token_counts,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_mixture_packing": op8_mixture_packing,
    "op9_uniform_sharding": op9_uniform_sharding,
    "op10_quality_knn": op10_quality_knn,
    "op11_lyndon_runs": op11_lyndon_runs,
    "op12_phrase_stripes": op12_phrase_stripes,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE: dict[str, str] = {
    "op4_embedding_neardup": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
              AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
        reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
        low AS (SELECT u, min(v) AS low FROM reach GROUP BY u),
        deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, least(e.vec_id, coalesce(low.low, e.vec_id)) AS component_id,
            e.vec_id = least(e.vec_id, coalesce(low.low, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN low ON e.vec_id = low.u LEFT JOIN deg ON e.vec_id = deg.u""",
    "op12_phrase_stripes": """
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
            SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
            FROM words, (SELECT unnest(generate_series(1, 5)) AS k))),
        freq AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(f) AS n FROM freq WHERE k = 1 GROUP BY lang),
        often AS (SELECT * FROM freq WHERE f >= 100),
        candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
        cuts AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n, (1000 * c.a * n) // (l.f * r.f) AS score
            FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidate) c
            JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:cut], ' ')
            JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
            JOIN total ON total.lang = c.lang),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_parts AS (SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase FROM (
            SELECT *, unnest(generate_series(i + 1, CAST(CASE WHEN i = 1 THEN k - 1 ELSE k END AS BIGINT))) AS j FROM (
                SELECT *, unnest(generate_series(1, k - 1)) AS i FROM candidate WHERE k > 2))),
        kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts p
            WHERE p.lang = b.lang AND p.phrase = b.phrase AND 100 * p.a >= 100 * b.a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
            CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
    "op13_substring_dedup": """
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (
            SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM texts)),
        firsts AS (SELECT x, min(doc_id) AS low FROM windows GROUP BY x),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i
            FROM windows JOIN firsts USING (x) WHERE low < doc_id),
        cut AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
        kept AS (SELECT t.doc_id, len(w) AS n, coalesce(len(g), 0) AS removed, CASE WHEN g IS NULL THEN w
            ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS left_over FROM texts t LEFT JOIN cut USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS n_removed,
            sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256 FROM kept""",
}
