"""The corpus operators' queries, and SQL for those that SQL can express."""

from strandframe.llm import audio, byte_bpe, language_id, minhash, mixing, token_counts, topk, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_language_id": language_id.op3_language_id,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_mixing": mixing.op5_mixing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_warc": warc.op8_warc,
    "op9_audio_fingerprint": audio.op9_audio_fingerprint,
    "op10_minhash_dedup": minhash.op10_minhash_dedup,
}

ORACLES = {
    "op5_mixing": mixing.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_minhash_dedup": minhash.ORACLE,
}
