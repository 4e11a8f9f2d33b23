"""Queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from advisorium.llm import annular, hnsw, langid, minhash, packing, pii, quality, repair, secrets, sentencepiece_codec, topk, url_filter, variants

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_topk": topk.op2_topk,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_quality": quality.op4_quality,
    "op5_language": langid.op5_language,
    "op6_secrets": secrets.op6_secrets,
    "op7_pii": pii.op7_pii,
    "op8_packing": packing.op8_packing,
    "op9_hnsw": hnsw.op9_hnsw,
    "op10_minhash": minhash.op10_minhash,
    "op11_repair": repair.op11_repair,
    "op12_annular": annular.op12_annular,
    "op13_variants": variants.op13_variants,
}
ORACLES = {
    "op1_url_filter": url_filter.SQL,
    "op2_topk": topk.SQL,
    "op9_hnsw": hnsw.SQL,
    "op10_minhash": minhash.SQL,
    "op12_annular": annular.SQL,
    "op13_variants": variants.SQL,
}
