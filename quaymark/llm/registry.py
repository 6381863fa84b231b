"""The queries of this package and their SQL."""

from . import alignment, ann, chat, exact_dedup, langid, lm, mixing, near_dedup, packing, pii, quality, search, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_language": langid.op4_language,
    "op5_lm_score": lm.op5_lm_score,
    "op6_quality": quality.op6_quality,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_ann": ann.op8_ann,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quotation_chat": chat.op10_quotation_chat,
    "op11_alignment": alignment.op11_alignment,
    "op12_lexical_search": search.op12_lexical_search,
    "op13_personal_data": pii.op13_personal_data,
}

ORACLES = {
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_quotation_chat": chat.ORACLE,
    "op12_lexical_search": search.ORACLE,
}
