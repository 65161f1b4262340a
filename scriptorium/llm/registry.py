"""The queries of this folder, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import ann, bpe, chat, decontaminate, fingerprints, jaccard, quality, suffixarray, tokenfile, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_suffix_array": suffixarray.op3_suffix_array,
    "op4_fingerprint_index": fingerprints.op4_fingerprint_index,
    "op5_token_files": tokenfile.op5_token_files,
    "op6_chat_windows": chat.op6_chat_windows,
    "op7_quality": quality.op7_quality,
    "op8_adaptive_scan": ann.op8_adaptive_scan,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_url_filter": urlfilter.op10_url_filter,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_jaccard_join": jaccard.ORACLE,
    "op3_suffix_array": suffixarray.ORACLE,
    "op4_fingerprint_index": fingerprints.ORACLE,
    "op6_chat_windows": chat.ORACLE,
    "op10_url_filter": urlfilter.ORACLE,
}
