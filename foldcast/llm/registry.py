"""The registered corpus queries, by name."""

from __future__ import annotations

from foldcast.llm import chat, collocations, decontaminate, hard_negatives, jaccard_join, language_id, line_dedup, lm_score, packing, quality, robust_quality, topk, warc


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard_join.query,
        "op2_chat_format": chat.query,
        "op3_language_id": language_id.query,
        "op4_line_dedup": line_dedup.query,
        "op5_quality_ranking": quality.query,
        "op6_lm_score": lm_score.query,
        "op7_packing": packing.query,
        "op8_top_k": topk.query,
        "op9_decontamination": decontaminate.query,
        "op10_warc_revisits": warc.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_collocations": collocations.query,
        "op13_robust_quality": robust_quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.SQL, "op8_top_k": topk.SQL, "op10_warc_revisits": warc.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_collocations": collocations.SQL}
