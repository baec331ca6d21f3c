"""The queries of this subpackage and the SQL of those that have one."""

from . import alignment, chat, exact_dedup, jaccard, licenses, line_dedup, mixing, negatives, pieces, quality, sharding, suffix, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_sharding": sharding.op2_sharding,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_warc": warc.op10_warc,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_licenses": licenses.op12_licenses,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
}
