"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binary import op10_token_files
from .bpe import op1_byte_bpe
from .language import op6_language_id
from .media import op2_audio_features
from .merkle import op13_merkle
from .mixing import op3_mixing
from .pii import op5_pii
from .quality import op9_quality_rules
from .simhash import op4_simhash
from .token_count import op7_token_counts
from .spelling import op11_spelling
from .toxicity import op8_toxicity
from .warc import op12_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_byte_bpe, op2_audio_features, op3_mixing, op4_simhash, op5_pii, op6_language_id, op7_token_counts, op8_toxicity, op9_quality_rules, op10_token_files, op11_spelling, op12_warc, op13_merkle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """None of them is expressible in SQL as a whole: tests hold them against libraries and brute force."""
    return {}
