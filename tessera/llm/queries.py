"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroids
from .importance import op6_importance
from .jaccard import op10_jaccard
from .licenses import op3_licenses
from .lines import OP1_SQL, op1_line_dedup
from .merkle import OP2_SQL, op2_merkle
from .mixing import OP7_SQL, op7_mixing
from .packing import op8_packing
from .pii import op5_private
from .repetition import op4_repetition
from .spelling import op11_spelling
from .toxicity import op9_toxicity
from .urls import op13_urls

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_merkle": op2_merkle,
    "op3_licenses": op3_licenses,
    "op4_repetition": op4_repetition,
    "op5_private": op5_private,
    "op6_importance": op6_importance,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard": op10_jaccard,
    "op11_spelling": op11_spelling,
    "op12_centroids": op12_centroids,
    "op13_urls": op13_urls,
}

SQL = {
    "op1_line_dedup": OP1_SQL,
    "op2_merkle": OP2_SQL,
    "op7_mixing": OP7_SQL,
    "op12_centroids": OP12_SQL,
}
