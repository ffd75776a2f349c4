"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import audit, decontamination, fingerprints, importance, linededup, mixing, neardup, pii, repeats, secrets, topk, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_pii": pii.op2_pii,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_url_filter": urls.op4_url_filter,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_repeats": repeats.op8_repeats,
    "op9_top_k": topk.op9_top_k,
    "op10_secrets": secrets.op10_secrets,
    "op11_resampling": importance.op11_resampling,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}

SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_url_filter": urls.OP4_SQL,
    "op5_near_duplicates": neardup.OP5_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op11_resampling": importance.OP11_SQL,
    "op12_filter_audit": audit.OP12_SQL,
}
