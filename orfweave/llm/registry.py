"""The text operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from . import clustering, exact_dedup, language_model, license_scan, mixing, packing, schema_rewrite, secret_scan, sharding, simhash, token_counts, topk, toxicity

_QUERIES = {
    "op1_token_counts": token_counts,
    "op2_license_scan": license_scan,
    "op3_secret_scan": secret_scan,
    "op4_mixing": mixing,
    "op5_sharding": sharding,
    "op6_exact_dedup": exact_dedup,
    "op7_topk": topk,
    "op8_simhash": simhash,
    "op9_packing": packing,
    "op10_toxicity": toxicity,
    "op11_schema_rewrite": schema_rewrite,
    "op12_language_model": language_model,
    "op13_clustering": clustering,
}


def queries() -> dict:
    # the pipeline stands at the top of the repository
    import corpus_pipeline

    return {name: module.query for name, module in _QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _QUERIES.items() if getattr(module, "ORACLE_SQL", None)}
