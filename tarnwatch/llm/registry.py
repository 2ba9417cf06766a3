"""Queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroids
from .line_dedup import OP6_SQL, op6_line_dedup
from .near_dup import OP10_SQL, op10_near_dup
from .packing import op9_packing
from .phrases import op2_phrases
from .pieces import op5_sentencepiece
from .quality import OP1_SQL, op1_quality_rules
from .quality_svm import op11_quality_classifier
from .resampling import OP13_SQL, op13_resampling
from .secrets import OP8_SQL, op8_secrets
from .toxicity import op4_toxicity
from .urls import OP7_SQL, op7_url_filters
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_phrases": op2_phrases,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_near_dup": op10_near_dup,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_centroids": op12_centroids,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_url_filters": OP7_SQL,
    "op8_secrets": OP8_SQL,
    "op10_near_dup": OP10_SQL,
    "op12_centroids": OP12_SQL,
    "op13_resampling": OP13_SQL,
}
