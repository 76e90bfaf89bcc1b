"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from . import exact, html, media, mixing, packing, simhash, substrings, token_counts, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_media_columns": media.op3_media_columns,
    "op4_warc": warc.op4_warc,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_packing": packing.op8_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}

ORACLES = {"op5_exact_dedup": exact.OP5_SQL}
