"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from tidemark.llm import bpe_automaton, jaccard_join, kneser_ney, language_id, line_dedup, mixing, phrases, quality_classifier, quality_rules, quote_links, rabitq, url_filter, weighted_kmeans


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            url_filter.op1_url_filter,
            quote_links.op2_quote_links,
            quality_rules.op3_quality_rules,
            bpe_automaton.op4_bpe_automaton,
            mixing.op5_mixing,
            quality_classifier.op6_quality_classifier,
            kneser_ney.op7_kneser_ney,
            jaccard_join.op8_jaccard_join,
            line_dedup.op9_line_dedup,
            rabitq.op10_rabitq,
            weighted_kmeans.op11_weighted_kmeans,
            language_id.op12_language_id,
            phrases.op13_phrases,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.OP1_SQL, "op3_quality_rules": quality_rules.OP3_SQL, "op5_mixing": mixing.OP5_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op11_weighted_kmeans": weighted_kmeans.OP11_SQL, "op13_phrases": phrases.OP13_SQL}
