"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from flowlens.llm import best_fit_packing, chat_format, collocations, embedding_whitening, hash_forest, html_extract, jaccard_join, language_id, media_archive, piece_sampling, quality_rules, url_filter, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_piece_sampling": piece_sampling.op5_piece_sampling,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_warc": warc.op7_warc,
    "op8_best_fit_packing": best_fit_packing.op8_best_fit_packing,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_media_archive": media_archive.op10_media_archive,
    "op11_embedding_whitening": embedding_whitening.op11_embedding_whitening,
    "op12_collocations": collocations.op12_collocations,
    "op13_hash_forest": hash_forest.op13_hash_forest,
}

ORACLE_SQL = {
    "op7_warc": warc.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
