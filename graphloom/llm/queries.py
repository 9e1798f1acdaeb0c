"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .blocks import OP11_SQL, op11_html_extraction
from .langid import op8_language_id
from .lines import OP3_SQL, op3_line_dedup
from .merkle import op12_merkle_manifest
from .mixing import OP5_SQL, op5_mixing
from .mpeg import op10_mpeg_audio
from .packing import op4_best_fit_packing
from .repair import op13_conversation_repair
from .simhash import op1_simhash
from .substrings import op7_substring_dedup
from .topk import OP2_SQL, op2_exact_top_k
from .toxicity import op9_toxicity
from .warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_exact_top_k, op3_line_dedup, op4_best_fit_packing, op5_mixing, op6_warc, op7_substring_dedup, op8_language_id, op9_toxicity, op10_mpeg_audio, op11_html_extraction, op12_merkle_manifest, op13_conversation_repair)
}
ORACLE_SQL = {"op2_exact_top_k": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_mixing": OP5_SQL, "op6_warc": OP6_SQL, "op11_html_extraction": OP11_SQL}
