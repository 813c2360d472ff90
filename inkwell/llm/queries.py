"""Queries of the training-data operators, one per operator, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import OP7_SQL, op7_decontaminate
from .html_template import op1_html_template
from .license_scan import op6_license_scan
from .lm_score import op3_cross_entropy
from .maxscore import OP2_SQL, op2_maxscore_topk
from .packing import op5_best_fit_packing
from .pii import op9_pii
from .quality import op4_quality
from .simhash import op10_simhash_dedup
from .suffix_dedup import op8_suffix_dedup

QUERIES = {
    "op1_html_template": op1_html_template,
    "op2_maxscore_topk": op2_maxscore_topk,
    "op3_cross_entropy": op3_cross_entropy,
    "op4_quality": op4_quality,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pii": op9_pii,
    "op10_simhash_dedup": op10_simhash_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_maxscore_topk": OP2_SQL,
    "op7_decontaminate": OP7_SQL,
}
