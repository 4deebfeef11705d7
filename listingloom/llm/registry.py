"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from listingloom.llm import chat, codes, decontaminate, fingerprints, html_text, language, minhash, mixing, packing, token_counts, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_compression_toxicity": toxicity.op1,
        "op2_warc_normaliser": warc.op2,
        "op3_cross_parsing_language": language.op3,
        "op4_merkle_fingerprints": fingerprints.op4,
        "op5_minhash_near_dedup": minhash.op5,
        "op6_chat_role_repair": chat.op6,
        "op7_spaced_seed_decontamination": decontaminate.op7,
        "op8_transducer_token_counts": token_counts.op8,
        "op9_crf_html_extraction": html_text.op9,
        "op10_pattern_packing": packing.op10,
        "op11_embedding_whitening": whitening.op11,
        "op12_vector_codes": codes.op12,
        "op13_source_mixing": mixing.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_normaliser": warc.ORACLE, "op7_spaced_seed_decontamination": decontaminate.ORACLE, "op12_vector_codes": codes.ORACLE}
