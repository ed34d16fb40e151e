"""Registered queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, centroids, chat_format, decontaminate, hard_negatives, html_extract, language_id, line_dedup, lm_score, near_dedup, quality, training_order, url_filter


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars", F.array_join(F.col("token_ids").cast("array<string>"), ",").alias("token_ids"))


def queries():
    return {
        "pipeline": pipeline,
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_chat_rotation": chat_format.op3_chat_rotation,
        "op4_language_id": language_id.op4_language_id,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_quality": quality.op7_quality,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_training_order": training_order.op9_training_order,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_main_text": html_extract.op11_main_text,
        "op12_centroid_clustering": centroids.op12_centroid_clustering,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql():
    return {"op3_chat_rotation": chat_format.SQL, "op12_centroid_clustering": centroids.SQL, "op13_hard_negatives": hard_negatives.SQL}
