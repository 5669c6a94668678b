"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, mixing, near_dup, quality, secrets, token_counts, topk, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_token_counts": token_counts.query,
    "op3_quality": quality.query,
    "op4_decontaminate": decontaminate.query,
    "op5_secrets": secrets.query,
    "op6_warc": warc.query,
    "op7_topk": topk.query,
    "op8_near_dup": near_dup.query,
    "op9_mixing": mixing.query,
    "op10_toxicity": toxicity.query,
}

SQL = {
    "op1_url_filter": url_filter.SQL,
    "op6_warc": warc.SQL,
    "op7_topk": topk.SQL,
    "op8_near_dup": near_dup.SQL,
}
