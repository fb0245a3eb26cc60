"""The registered queries of the training-data operators, with their SQL."""

from lexloom.llm import ann, chat_format, line_dedup, media, mixing, ngram_join, packing, quality, spelling_variants, substring_dedup, token_rollup, tokenizer_alignment, url_filters

QUERIES = {
    "op1_nearest_neighbours": ann.op1_nearest_neighbours,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_tokenizer_alignment": tokenizer_alignment.op11_tokenizer_alignment,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_chat_formatting": chat_format.op13_chat_formatting,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_media_columns": media.op5_media_columns,
    "op6_token_rollup": token_rollup.op6_token_rollup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_mix_sources": mixing.op9_mix_sources,
}
ORACLES = {
    "op12_spelling_variants": spelling_variants.OP12_SQL,
    "op13_chat_formatting": chat_format.OP13_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
}
