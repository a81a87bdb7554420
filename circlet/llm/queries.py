"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from .conversations import OP11_SQL, op11_conversation_repair
from .decontam import OP8_SQL, op8_decontaminate
from .embeddings import OP6_SQL, op6_embedding_collisions
from .html_text import op10_html_layout
from .language_id import op12_language_id
from .language_model import op9_gated_lm
from .line_dedup import OP2_SQL, op2_line_dedup
from .packing import op3_best_fit_packing
from .simhash import op5_simhash_golay
from .token_output import op1_token_orc
from .toxicity import op4_toxicity
from .warc import OP7_SQL, op7_warc_index

QUERIES = {
    "op1_token_orc": op1_token_orc,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_golay": op5_simhash_golay,
    "op6_embedding_collisions": op6_embedding_collisions,
    "op7_warc_index": op7_warc_index,
    "op8_decontaminate": op8_decontaminate,
    "op9_gated_lm": op9_gated_lm,
    "op10_html_layout": op10_html_layout,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_language_id": op12_language_id,
}

ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op6_embedding_collisions": OP6_SQL,
    "op7_warc_index": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op11_conversation_repair": OP11_SQL,
}
