"""The queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

import corpus_pipeline

from . import chat, dedup, extraction, fingerprint, langid, mixing, packing, quality, sharding, urls

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_quality_rules": quality.query,
    "op3_fingerprints": fingerprint.query,
    "op4_mixing": mixing.query,
    "op5_html_extraction": extraction.query,
    "op6_url_filters": urls.query,
    "op7_language_id": langid.query,
    "op8_packing": packing.query,
    "op9_near_dedup": dedup.query,
    "op10_sharding": sharding.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op1_chat_format": chat.SQL, "op2_quality_rules": quality.SQL, "op4_mixing": mixing.SQL, "op9_near_dedup": dedup.SQL}
