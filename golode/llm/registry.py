"""Queries of the training-data operators and the SQL that checks them."""

from golode.llm import bpe, exact_dedup, html_text, licenses, near_dedup, packing, quality, token_files, topk, warc

QUERIES = {
    "op1_packing": packing.op1,
    "op2_order_minhash": near_dedup.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_token_files": token_files.op4,
    "op5_topk": topk.op5,
    "op6_html_text": html_text.op6,
    "op7_licenses": licenses.op7,
    "op8_quality": quality.op8,
    "op9_warc": warc.op9,
    "op10_exact_dedup": exact_dedup.op10,
}

ORACLES = {
    "op5_topk": topk.OP5_SQL,
    "op6_html_text": html_text.OP6_SQL,
    "op7_licenses": licenses.OP7_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
