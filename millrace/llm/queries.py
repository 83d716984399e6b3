"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm import (
    bloom_lm,
    bpe,
    decontaminate,
    fim,
    html_crf,
    hyperminhash,
    line_dedup,
    merkle,
    oracles,
    ppm,
    quality,
    suffix_index,
    url_rules,
    warc,
)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_warc": warc.op2_warc,
    "op3_bpe": bpe.op3_bpe,
    "op4_html": html_crf.op4_html,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_lm_score": bloom_lm.op6_lm_score,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_language": ppm.op8_language,
    "op9_suffix_dedup": suffix_index.op9_suffix_dedup,
    "op10_near_dedup": hyperminhash.op10_near_dedup,
    "op11_url_filter": url_rules.op11_url_filter,
    "op12_manifest": merkle.op12_manifest,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op5_decontaminate": oracles.DECONTAMINATE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_suffix_dedup": oracles.REPEATS,
    "op10_near_dedup": oracles.NEAR_COPIES,
    "op11_url_filter": url_rules.ORACLE,
    "op12_manifest": merkle.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
