"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation import OP12_SQL, op12_conversation_repair
from .embedding import OP9_SQL, op9_embedding_near_dedup
from .fingerprint import op11_fingerprints
from .jaccard import OP7_SQL, op7_ngram_jaccard_join
from .language import op6_language_id
from .license import op2_license_scan
from .packing import op5_packing
from .quality import OP1_SQL, op1_quality_rules
from .sentencepiece_codec import op4_sentencepiece
from .sharding import OP10_SQL, op10_sharding
from .spelling import OP13_SQL, op13_spelling
from .substring import OP8_SQL, op8_substring_dedup
from .token_counts import op3_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_sharding": op10_sharding,
    "op11_fingerprints": op11_fingerprints,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op10_sharding": OP10_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
