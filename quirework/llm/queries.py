"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, manifest, near_dedup, url_filter, vector_search
from .bpe import op10_byte_bpe
from .lm_score import op4_lm_score
from .packing import op2_packing
from .pii import op7_pii
from .quality import op8_quality_rules
from .quality_trees import op13_quality_trees
from .secrets import op9_secret_scan
from .token_counts import op5_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_packing": op2_packing,
    "op3_near_duplicates": near_dedup.op3_near_duplicates,
    "op4_lm_score": op4_lm_score,
    "op5_token_counts": op5_token_counts,
    "op6_top_k": vector_search.op6_top_k,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_collocations": collocations.op12_collocations,
    "op13_quality_trees": op13_quality_trees,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE,
    "op3_near_duplicates": near_dedup.ORACLE,
    "op6_top_k": vector_search.ORACLE,
    "op11_merkle_manifest": manifest.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
