"""The operators' queries and the SQL they are checked against."""

from __future__ import annotations

from tidewatch.llm import alignment, binary_output, embedding_dedup, importance, jaccard_join, license_scan, oracles, packing, prefix_bpe, quality_model, quality_rules, sentencepiece_codec, substring_dedup, toxicity


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    found = [
        toxicity.op1_toxicity,
        packing.op2_best_fit_packing,
        substring_dedup.op3_substring_dedup,
        jaccard_join.op4_ngram_jaccard_join,
        quality_rules.op5_quality_rules,
        quality_model.op6_quality_classifier,
        sentencepiece_codec.op7_sentencepiece,
        embedding_dedup.op8_embedding_near_dedup,
        binary_output.op9_binary_output,
        license_scan.op10_license_scan,
        prefix_bpe.op11_prefix_bpe,
        importance.op12_importance_resampling,
        alignment.op13_tokenizer_alignment,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    """Query name -> DuckDB SQL."""
    return {
        "op3_substring_dedup": oracles.SUBSTRINGS,
        "op4_ngram_jaccard_join": oracles.JACCARD,
        "op5_quality_rules": oracles.quality(),
        "op8_embedding_near_dedup": oracles.EMBEDDINGS,
        "op12_importance_resampling": oracles.IMPORTANCE,
    }
