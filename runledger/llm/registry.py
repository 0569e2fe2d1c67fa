"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.llm import (
    context_trees,
    inner_product_search,
    mixing,
    near_duplicates,
    packing,
    page_text,
    personal_data,
    quality_classifier,
    quality_rules,
    spelling_variants,
    token_files,
    vector_clusters,
    vector_duplicates,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": token_files.query,
        "op2_quality_rules": quality_rules.query,
        "op3_context_trees": context_trees.query,
        "op4_personal_data": personal_data.query,
        "op5_quality_classifier": quality_classifier.query,
        "op6_page_text": page_text.query,
        "op7_near_duplicates": near_duplicates.query,
        "op8_vector_duplicates": vector_duplicates.query,
        "op9_mixing": mixing.query,
        "op10_best_fit_packing": packing.query,
        "op11_vector_clusters": vector_clusters.query,
        "op12_spelling_variants": spelling_variants.query,
        "op13_inner_product_search": inner_product_search.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.oracle_sql(),
        "op11_vector_clusters": vector_clusters.oracle_sql(),
        "op12_spelling_variants": spelling_variants.oracle_sql(),
        "op13_inner_product_search": inner_product_search.oracle_sql(),
    }
