"""The registered queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from corpusmill.llm import (
    archive,
    html_text,
    language,
    leaks,
    licences,
    lines,
    lloyd,
    mixing,
    near,
    negatives,
    substring,
    token_file,
    topk,
)

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_mix": mixing.op2_mix,
    "op3_substring": substring.op3_substring,
    "op4_html": html_text.op4_html,
    "op5_topk": topk.op5_topk,
    "op6_tokens": token_file.op6_tokens,
    "op7_archive": archive.op7_archive,
    "op8_leaks": leaks.op8_leaks,
    "op9_near": near.op9_near,
    "op10_language": language.op10_language,
    "op11_negatives": negatives.op11_negatives,
    "op12_clusters": lloyd.op12_clusters,
    "op13_licences": licences.op13_licences,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_lines": lines.SQL,
    "op2_mix": mixing.SQL,
    "op5_topk": topk.SQL,
    "op11_negatives": negatives.SQL,
    "op12_clusters": lloyd.SQL,
    "op13_licences": licences.SQL,
}
