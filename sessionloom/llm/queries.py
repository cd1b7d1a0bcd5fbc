"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, html_text, language_id, license_scan, near_dedup, packing, piece_tokens, prefix_trie, quality, tiff_media, token_alignment, top_search, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_sentencepiece": piece_tokens.op3_sentencepiece,
    "op4_html_text": html_text.op4_html_text,
    "op5_packing": packing.op5_packing,
    "op6_media": tiff_media.op6_media,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_language": language_id.op9_language,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_top_search": top_search.op13_top_search,
}

SQL: dict[str, str] = {
    "op2_near_dedup": near_dedup.oracle_sql(),
    "op7_url_filter": url_filter.oracle_sql(),
    "op10_embedding_dedup": embedding_dedup.oracle_sql(),
    "op11_prefix_trie": prefix_trie.oracle_sql(),
    "op13_top_search": top_search.oracle_sql(),
}
