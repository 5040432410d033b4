"""Registered queries of the subpackage and, where SQL can state the same
result, their DuckDB SQL."""

from . import (ann, conversation_repair, decontam, embedding_dedup, html_extract, langid, line_dedup, minhash, quality,
               sentencepiece_nbest, suffix_dedup, toxicity, whitening)

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_ann": ann.op3_ann,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sentencepiece": sentencepiece_nbest.op8_sentencepiece,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_language_id": langid.op10_language_id,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

SQL = {
    "op1_minhash": minhash.SQL,
    "op4_suffix_dedup": suffix_dedup.SQL,
    "op5_decontamination": decontam.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op13_embedding_dedup": embedding_dedup.SQL,
}
