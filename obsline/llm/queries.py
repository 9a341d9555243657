"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from obsline.llm.ann import op9_one_bit_ann
from obsline.llm.bpe import op7_byte_bpe
from obsline.llm.chat import OP3_SQL, op3_chat_format
from obsline.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from obsline.llm.language_model import op5_language_model
from obsline.llm.license_scan import OP4_SQL, op4_license_scan
from obsline.llm.merkle import OP11_SQL, op11_merkle_manifest
from obsline.llm.packing import op10_best_fit_packing
from obsline.llm.simhash import op1_simhash
from obsline.llm.token_counts import op12_token_counts
from obsline.llm.toxicity import op6_toxicity
from obsline.llm.url_filter import OP2_SQL, op2_url_filter
from obsline.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_language_model": op5_language_model,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_one_bit_ann": op9_one_bit_ann,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
