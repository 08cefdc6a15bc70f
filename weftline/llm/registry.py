"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.alignment import op13_alignment
from weftline.llm.ann import op8_ann
from weftline.llm.bpe import op4_bpe
from weftline.llm.html_text import op3_html_text
from weftline.llm.importance import OP11_SQL, op11_importance
from weftline.llm.language import op9_language
from weftline.llm.lm import op10_lm
from weftline.llm.mixing import op7_mixing
from weftline.llm.near_dedup import op6_near_dedup
from weftline.llm.quality import op5_quality
from weftline.llm.simhash import op2_simhash
from weftline.llm.token_counts import op1_token_counts
from weftline.llm.warc import OP12_SQL, op12_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_html_text, op4_bpe, op5_quality, op6_near_dedup, op7_mixing, op8_ann, op9_language, op10_lm, op11_importance, op12_warc, op13_alignment)}
ORACLE_SQL: dict[str, str] = {"op11_importance": OP11_SQL, "op12_warc": OP12_SQL}
