"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlytics.llm import language, lattice, licenses, minhash, negatives, packing, quality, repeats, runs, tiling, tokenfile, toxicity, urls
from reviewlytics.llm.common import table
from reviewlytics.operators.lineage import scratch_folder


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-files")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_tokens(spark, folder)


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lattice_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op12_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.with_stutter(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op3_tiling_decontamination": op3_tiling_decontamination,
    "op4_lattice_near_vectors": op4_lattice_near_vectors,
    "op5_additive_quality": op5_additive_quality,
    "op6_language_mixture": op6_language_mixture,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_boosted_url_filter": op11_boosted_url_filter,
    "op12_four_russians_negatives": op12_four_russians_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}
#: The results of the others cannot be stated in SQL (vocabularies, learned models, tilings) or only
#: too slowly on whole tables (byte strings, all pairs of vectors); tests/llm holds them against
#: plain versions.
ORACLE_SQL: dict[str, str] = {
    "op9_minhash_near_dedup": r"""
        WITH RECURSIVE word AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingle AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i
                  FROM word WHERE len(w) > 0) AS x),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingle AS a JOIN shingle AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (
            SELECT a, b FROM common AS c JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b
            WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
        reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM word
            UNION SELECT r.doc_id, l.b FROM reached AS r JOIN link AS l ON r.other = l.a),
        least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
        FROM least LEFT JOIN size USING (doc_id)""",
    "op12_four_russians_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same,
                   CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
            FROM v AS a JOIN v AS c ON a.vec_id <> c.vec_id AND len(a.q) = len(c.q) WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
               other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
}
