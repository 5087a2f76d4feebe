"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lumentrace.llm.curriculum import OP5_SQL, op5_curriculum
from lumentrace.llm.filter_audit import OP11_SQL, op11_filter_audit
from lumentrace.llm.line_dedup import OP6_SQL, op6_line_dedup
from lumentrace.llm.main_text import op2_main_text
from lumentrace.llm.neighbours import op13_neighbours
from lumentrace.llm.packing import op4_packing
from lumentrace.llm.pii import op7_pii
from lumentrace.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from lumentrace.llm.quality import op9_quality
from lumentrace.llm.simhash_groups import op10_simhash_groups
from lumentrace.llm.topk import OP3_SQL, op3_topk
from lumentrace.llm.toxicity import op8_toxicity
from lumentrace.llm.warc import OP1_SQL, op1_warc_derivatives

QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_main_text": op2_main_text,
    "op3_topk": op3_topk,
    "op4_packing": op4_packing,
    "op5_curriculum": op5_curriculum,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_simhash_groups": op10_simhash_groups,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_neighbours": op13_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_derivatives": OP1_SQL,
    "op3_topk": OP3_SQL,
    "op5_curriculum": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
