"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from bedside.llm import (
    centroid_clusters,
    html_extract,
    jaccard_join,
    lexical_search,
    mixing,
    piece_scan,
    quality_rules,
    suffix_dedup,
    token_files,
    toxicity,
    url_filter,
    vector_search,
    warc_files,
)

QUERIES = {
    "op1_piece_scan": piece_scan.op1_piece_scan,
    "op2_vector_search": vector_search.op2_vector_search,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_token_files": token_files.op6_token_files,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_warc_files": warc_files.op11_warc_files,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
}

ORACLES = {
    "op2_vector_search": vector_search.OP2_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_warc_files": warc_files.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_centroid_clusters": centroid_clusters.OP13_SQL,
}
