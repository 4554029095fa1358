"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_query
from .crf import op3_query
from .html import op9_query
from .lines import op4_query
from .negatives import OP12_SQL, op12_query
from .neighbours import op7_query
from .packing import op6_query
from .rules import op10_query
from .sharding import op5_query
from .simhash import op1_query
from .tokens import op2_query
from .trie import OP13_SQL, op13_query
from .urls import OP11_SQL, op11_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_query,
    "op2_token_output": op2_query,
    "op3_quality_crf": op3_query,
    "op4_line_dedup": op4_query,
    "op5_sharding": op5_query,
    "op6_packing": op6_query,
    "op7_embeddings": op7_query,
    "op8_bpe": op8_query,
    "op9_html_extraction": op9_query,
    "op10_quality_rules": op10_query,
    "op11_url_filters": op11_query,
    "op12_hard_negatives": op12_query,
    "op13_prefix_trie": op13_query,
}

ORACLE: dict[str, str] = {"op11_url_filters": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
