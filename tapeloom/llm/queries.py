"""The queries of the corpus operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from tapeloom.llm import (
    chat_format,
    collocations,
    exact_dedup,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    simhash,
    toxicity,
    url_filter,
    vector_forest,
    whitening,
)


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_mixing": mixing.op3_mixing,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_packing": packing.op6_packing,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_collocations": collocations.op11_collocations,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_embedding_near_dedup": vector_forest.op13_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat_format.OP2_SQL,
        "op4_quality_rules": quality_rules.OP4_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op11_collocations": collocations.OP11_SQL,
    }
