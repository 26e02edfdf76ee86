"""This subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import bpe, decontaminate, kmeans, lines, lm, negatives, pii, quality, rules, simhash, topk, toxicity, urls

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality, rules.op2_quality_rules, simhash.op3_simhash, decontaminate.op4_decontamination, lines.op5_line_dedup,
        pii.op6_pii, lm.op7_lm_scoring, bpe.op8_bpe, urls.op9_url_filter, toxicity.op10_toxicity,
        topk.op11_exact_topk, negatives.op12_hard_negatives, kmeans.op13_centroid_clustering,
        decontaminate.decontamination_matches, urls.pages_of_junk_hosts,
    )
}

ORACLE_SQL = {
    "op4_decontamination": decontaminate.OP4_SQL, "decontamination_matches": decontaminate.MATCHES_SQL, "op5_line_dedup": lines.OP5_SQL, "op9_url_filter": urls.OP9_SQL, "pages_of_junk_hosts": urls.JUNK_SQL,
    "op11_exact_topk": topk.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL, "op13_centroid_clustering": kmeans.OP13_SQL,
}
