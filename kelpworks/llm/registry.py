"""Queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from kelpworks.llm.bpe import op11_bpe
from kelpworks.llm.decontaminate import OP2_SQL, op2_decontaminate, op2_proximity
from kelpworks.llm.divergence import OP13_SQL, op13_divergence
from kelpworks.llm.language import op6_language
from kelpworks.llm.line_dedup import OP3_SQL, op3_line_dedup
from kelpworks.llm.mixing import op8_mixing
from kelpworks.llm.near_dedup import OP7_SQL, op7_near_dedup
from kelpworks.llm.pii import op1_pii
from kelpworks.llm.quality import op10_quality
from kelpworks.llm.substring_dedup import op5_substring_dedup
from kelpworks.llm.topk import OP4_SQL, op4_topk
from kelpworks.llm.turns import OP12_SQL, op12_repair
from kelpworks.llm.url_filter import op9_url_filter


def queries() -> dict:
    return {"op1_pii": op1_pii, "op2_decontaminate": op2_decontaminate, "op2_proximity": op2_proximity, "op3_line_dedup": op3_line_dedup, "op4_topk": op4_topk, "op5_substring_dedup": op5_substring_dedup, "op6_language": op6_language, "op7_near_dedup": op7_near_dedup, "op8_mixing": op8_mixing, "op9_url_filter": op9_url_filter, "op10_quality": op10_quality, "op11_bpe": op11_bpe, "op12_repair": op12_repair, "op13_divergence": op13_divergence}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_topk": OP4_SQL, "op7_near_dedup": OP7_SQL, "op12_repair": OP12_SQL, "op13_divergence": OP13_SQL}
