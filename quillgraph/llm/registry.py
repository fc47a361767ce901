"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillgraph.llm import collocations, editprints, fillmiddle, linededup, mixing, oddsketch, pieces, private, quality, simhash, suffixes, topk, urlfilter

QUERIES = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_url_redirects": urlfilter.op2_url_redirects,
    "op3_simhash_bktree": simhash.op3_simhash_bktree,
    "op4_mixing_pareto": mixing.op4_mixing_pareto,
    "op5_quality_resampling": quality.op5_quality_resampling,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_topk_pivot": topk.op7_topk_pivot,
    "op8_sentencepiece_viterbi": pieces.op8_sentencepiece_viterbi,
    "op9_edit_fingerprints": editprints.op9_edit_fingerprints,
    "op10_private_boosting": private.op10_private_boosting,
    "op11_fill_middle": fillmiddle.op11_fill_middle,
    "op12_collocations": collocations.op12_collocations,
    "op13_odd_sketches": oddsketch.op13_odd_sketches,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_url_redirects": urlfilter.ORACLE,
    "op4_mixing_pareto": mixing.ORACLE,
    "op7_topk_pivot": topk.ORACLE,
    "op11_fill_middle": fillmiddle.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_odd_sketches": oddsketch.ORACLE,
}
