"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import codebooks, common, embeddings, jaccard, linededup, media, mixing, negatives, packing, quality, secrets, suffixes, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.op1_token_files,
    "op2_weighted_mix": mixing.op2_weighted_mix,
    "op3_attention_toxicity": toxicity.op3_attention_toxicity,
    "op4_importance_resampling": quality.op4_importance_resampling,
    "op5_retrieval_packing": packing.op5_retrieval_packing,
    "op6_winnowed_lines": linededup.op6_winnowed_lines,
    "op7_progressive_jpeg": media.op7_progressive_jpeg,
    "op8_random_secrets": secrets.op8_random_secrets,
    "op9_rotated_codes": embeddings.op9_rotated_codes,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_yinyang_codes": codebooks.op11_yinyang_codes,
    "op12_induced_suffixes": suffixes.op12_induced_suffixes,
    "op13_norm_bucketed_negatives": negatives.op13_norm_bucketed_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_weighted_mix": mixing.ORACLE_OP2,
    "op11_yinyang_codes": codebooks.ORACLE_OP11,
    "op12_induced_suffixes": suffixes.ORACLE_OP12,
    "op13_norm_bucketed_negatives": negatives.ORACLE_OP13,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

QUERIES = {name: common.shipped(query) for name, query in QUERIES.items()}
