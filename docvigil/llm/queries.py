"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvigil.llm.common import crc_mod, table

#: The end id that the contracts of ops 1 and 8 name.
END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.mixing import mix_sources

    mix = mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mix.select("row.doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.exact_dedup import exact_groups

    groups = exact_groups(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return groups.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def language_training() -> Column:
    """Rows that op 2 may learn from."""
    return crc_mod(F.col("doc_id"), 3) != 1


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.language_id import fit_language, language_sample, predict_language

    docs = table(spark, sf_dir, "documents")
    model = fit_language(language_sample(docs, language_training(), per_language=150))
    found = predict_language(docs, model)
    return found.select("doc_id", (~language_training()).alias("held_out"), "lang_pred", "score")


def op6_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.tiff_media import decode_pages, texts_as_files, with_features

    # a page may fill a Spark value: these files are our own
    pages = with_features(decode_pages(texts_as_files(table(spark, sf_dir, "documents")), most_bytes=(1 << 31) - 1))
    return pages.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def toxicity_model(spark: SparkSession, sf_dir: str):
    from docvigil.llm.toxicity import train_toxicity

    return train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.toxicity import score_toxicity

    found = score_toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "threshold", "rejected")


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.importance import importance_sample

    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.ball_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvigil.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_media_tiff": op6_media_tiff,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality_resampling": op10_quality_resampling,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_top_k": op12_top_k,
    "op13_whitening": op13_whitening,
}
#: Vectors that take part, as whole numbers.
WHOLE = """
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
"""
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": f"""
        WITH v AS (
            SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
            FROM ({WHOLE}) WHERE label IS NOT NULL
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ), positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id,
               positive_score, score AS negative_score
        FROM positive JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op12_top_k": f"""
        WITH v AS ({WHOLE}), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50
        ), hashed AS (
            SELECT doc_id, pos, sha256(array_to_string(words[pos : pos + 49], ' ')) AS h FROM windows
        ), first AS (
            SELECT h, min(doc_id) AS lo FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM hashed JOIN first USING (h) WHERE doc_id > lo
        ), lost AS (
            SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(l), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: l IS NULL OR NOT list_contains(l, i)), lambda i: words[i]), ' ')) AS kept_sha256
        FROM w LEFT JOIN lost USING (doc_id)
    """,
}
