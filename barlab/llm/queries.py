"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from barlab.llm import chat, collocations, embed_lsh, gam, licenses, lm, packing, pieces, prefix_trie, simhash, suffix, topk, wordpiece

QUERIES = {
    "op1_lm_scores": lm.op1_lm_scores,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_topk": topk.op3_topk,
    "op4_chat_format": chat.op4_chat_format,
    "op5_embedding_dedup": embed_lsh.op5_embedding_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality": gam.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_token_counts": wordpiece.op10_token_counts,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_licenses": licenses.op12_licenses,
    "op13_collocations": collocations.op13_collocations,
}
SQL = {k: v for m in (chat, collocations, embed_lsh, gam, licenses, lm, packing, pieces, prefix_trie, simhash, suffix, topk, wordpiece) for k, v in m.SQL.items()}
