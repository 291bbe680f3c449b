"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lattica.llm import flac, licenses, linedup, neardup, packing, pieces, repeats, topk, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_topk": topk.op3_topk,
    "op4_packing": packing.op4_packing,
    "op5_linedup": linedup.op5_linedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_neardup": neardup.op7_neardup,
    "op8_licenses": licenses.op8_licenses,
    "op9_flac": flac.op9_flac,
    "op10_repeats": repeats.op10_repeats,
}

#: The others are held against brute force, libraries or held-out labels in tests/llm.
ORACLES = {"op1_warc": warc.ORACLE, "op3_topk": topk.ORACLE, "op5_linedup": linedup.ORACLE, "op8_licenses": licenses.ORACLE}
