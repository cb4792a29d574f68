"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from graphloom.llm import chat, collocations, decontaminate, embedding_dedup, html_text, lattice_lm, license_scan, line_dedup, quality, sentencepiece_codec, simhash, spelling, toxicity

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_embedding_near_dedup": embedding_dedup.op4_embedding_near_dedup,
    "op5_lattice_lm": lattice_lm.op5_lattice_lm,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_html_text": html_text.op8_html_text,
    "op9_sentencepiece_codec": sentencepiece_codec.op9_sentencepiece_codec,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_toxicity": toxicity.op13_toxicity,
}

SQL: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
}
