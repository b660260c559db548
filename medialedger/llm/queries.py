"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ctxmix import op6_lm_scoring
from .langid import op7_language_id
from .merkle import OP12_SQL, op12_merkle_manifest
from .mincut_html import op8_html_extraction
from .mixing import OP2_SQL, op2_mixing
from .packing import op13_best_fit_packing
from .pieces import op3_sentencepiece
from .prefix_trie import OP11_SQL, op11_conversation_trie
from .quality import op4_quality
from .rotated_codes import op1_embedding_near_dedup
from .simhash import op9_simhash
from .suffix_dedup import op10_suffix_dedup
from .warc import OP5_SQL, op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_html_extraction": op8_html_extraction,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLE: dict[str, str] = {"op2_mixing": OP2_SQL, "op5_warc": OP5_SQL, "op11_conversation_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
