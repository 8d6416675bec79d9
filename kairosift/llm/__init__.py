"""Operators of a training-data pipeline; nothing outside this package imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, html_extract, lang_crf, line_dedup, minhash_dedup, packing, piece_codec, quality_lm, risk_rules, suffix_dedup, url_filter, whitening, word_runs


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_piece_codec": piece_codec.op2_piece_codec,
        "op3_quality_lm": quality_lm.op3_quality_lm,
        "op4_lang_crf": lang_crf.op4_lang_crf,
        "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
        "op6_risk_rules": risk_rules.op6_risk_rules,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_packing": packing.op9_packing,
        "op10_ann": ann.op10_ann,
        "op11_html_extract": html_extract.op11_html_extract,
        "op12_word_runs": word_runs.op12_word_runs,
        "op13_whitening": whitening.op13_whitening,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_dedup": minhash_dedup.OP5_SQL, "op8_line_dedup": line_dedup.OP8_SQL}
