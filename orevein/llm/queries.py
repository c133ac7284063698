"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .exact_dedup import OP10_SQL, op10_exact_dedup
from .importance import op4_importance
from .main_text import OP12_SQL, op12_main_text
from .mixing import op6_mixing
from .near_dedup import OP7_SQL, op7_near_dedup
from .passages import op1_passages
from .periodic import OP13_SQL, op13_periodic_runs
from .pieces import op5_sentencepiece
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .private_data import op9_private_data
from .quality_rules import op8_quality_rules
from .sharding import OP2_SQL, op2_sharding
from .token_counts import op3_token_counts

QUERIES = {
    "op1_passages": op1_passages,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_importance": op4_importance,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_mixing": op6_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_private_data": op9_private_data,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_main_text": op12_main_text,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {"op2_sharding": OP2_SQL, "op7_near_dedup": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_main_text": OP12_SQL, "op13_periodic_runs": OP13_SQL}
