"""Operators for preparing training text. Nothing else in the library imports this package."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprint, html_extract, knn, langid, line_dedup, negatives, ngram_join, packing, quotes, url_filter, whitening


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_document_fingerprints": fingerprint.op3_document_fingerprints,
        "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
        "op5_language_id": langid.op5_language_id,
        "op6_voronoi_knn": knn.op6_voronoi_knn,
        "op7_quotation_linking": quotes.op7_quotation_linking,
        "op8_packing": packing.op8_packing,
        "op9_tag_path_extraction": html_extract.op9_tag_path_extraction,
        "op10_fuzzy_line_dedup": line_dedup.op10_fuzzy_line_dedup,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.OP1_SQL, "op6_voronoi_knn": knn.OP6_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_exact_dedup": exact_dedup.OP12_SQL}
