"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from rolegraph.llm import bpe, chat, credentials, exact_dedup, infill, licenses, near_dedup, packing, quality, search, toxicity, vectors, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_bpe_roundtrip": bpe.op2_bpe_roundtrip,
    "op3_chat_windows": chat.op3_chat_windows,
    "op4_warc_roundtrip": warc.op4_warc_roundtrip,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_vector_dedup": vectors.op8_vector_dedup,
    "op9_packing": packing.op9_packing,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_secret_scan": credentials.op11_secret_scan,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}
ORACLES = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op4_warc_roundtrip": warc.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op12_ranked_search": search.OP12_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
