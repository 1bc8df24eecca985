"""The operators' queries, and SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from tallyloom.llm import alignment, bpe, chat, crf, decontam, hmm, lexical, minhash, pieces, secret_scan, sharding, suffix, topk

QUERIES = {
    "op1_hyperminhash": minhash.op1_hyperminhash,
    "op2_jump_sharding": sharding.op2_jump_sharding,
    "op3_hmm_score": hmm.op3_hmm_score,
    "op4_exact_topk": topk.op4_exact_topk,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_crf_toxicity": crf.op7_crf_toxicity,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_bpe": bpe.op10_bpe,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_ranked_search": lexical.op12_ranked_search,
    "op13_cross_alignment": alignment.op13_cross_alignment,
}

ORACLES = {
    "op1_hyperminhash": minhash.ORACLE,
    "op4_exact_topk": topk.ORACLE,
    "op9_secret_scan": secret_scan.ORACLE,
    "op12_ranked_search": lexical.ORACLE,
}
