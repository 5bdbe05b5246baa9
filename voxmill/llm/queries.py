"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from .alignment import op13_alignment
from .chat import OP8_SQL, op8_chat
from .decontamination import op6_decontamination
from .html import op7_html
from .neardup import op1_neardup
from .packing import op3_packing
from .quality import op9_quality
from .sharding import op4_sharding
from .spelling import OP12_SQL, op12_spelling
from .substrings import op10_substrings
from .topk import OP2_SQL, op2_topk
from .toxicity import op5_toxicity
from .urlrules import OP11_SQL, op11_urls

QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_topk": op2_topk,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_html": op7_html,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_substrings": op10_substrings,
    "op11_urls": op11_urls,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL = {"op2_topk": OP2_SQL, "op8_chat": OP8_SQL, "op11_urls": OP11_SQL, "op12_spelling": OP12_SQL}
