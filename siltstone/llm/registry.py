"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .op1_line_alignment import op1_line_alignment
from .op2_rans import op2_rans_tokens
from .op3_url_lists import OP3_SQL, op3_url_lists
from .op4_suffix_trees import op4_suffix_trees
from .op5_suffix_array import op5_suffix_array
from .op6_lsh_forest import op6_lsh_forest
from .op7_packing import op7_best_fit_packing
from .op8_toxicity import op8_toxicity
from .op9_decontamination import op9_decontamination
from .op10_sorted_projections import op10_sorted_projections
from .op11_collocations import OP11_SQL, op11_collocations
from .op12_contextual_pii import op12_contextual_pii
from .op13_conversation_repair import OP13_SQL, op13_conversation_repair
from .sql import OP4_SQL, OP5_SQL, OP6_SQL, OP10_SQL

QUERIES = {
    "op1_line_alignment": op1_line_alignment,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_url_lists": op3_url_lists,
    "op4_suffix_trees": op4_suffix_trees,
    "op5_suffix_array": op5_suffix_array,
    "op6_lsh_forest": op6_lsh_forest,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_sorted_projections": op10_sorted_projections,
    "op11_collocations": op11_collocations,
    "op12_contextual_pii": op12_contextual_pii,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL = {
    "op3_url_lists": OP3_SQL,
    "op4_suffix_trees": OP4_SQL,
    "op5_suffix_array": OP5_SQL,
    "op6_lsh_forest": OP6_SQL,
    "op10_sorted_projections": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
