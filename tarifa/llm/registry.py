"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tarifa.llm import collocations, html_text, langid, line_dedup, merkle, mixing, oracles, packing, quality, simhash, suffix_dedup, toxicity, warc, whitening

QUERIES = {
    "op7_merkle": merkle.op7_merkle,
    "op5_quality": quality.op5_quality,
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_packing": packing.op2_packing,
    "op9_warc": warc.op9_warc,
    "op3_simhash": simhash.op3_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op4_html": html_text.op4_html,
    "op8_toxicity": toxicity.op8_toxicity,
    "op10_langid": langid.op10_langid,
    "op11_collocations": collocations.op11_collocations,
    "op12_whitening": whitening.op12_whitening,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

#: The other methods hash, learn or tokenize in ways that SQL does not offer; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": oracles.SUFFIX_DEDUP, "op7_merkle": oracles.MERKLE, "op9_warc": oracles.WARC, "op11_collocations": oracles.COLLOCATIONS, "op13_line_dedup": oracles.LINE_DEDUP}
