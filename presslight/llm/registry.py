"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat, collocations, htmltext, imatch, knn, lm, minhash, mixing, quality, sharding, tokenfile, trie

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_sharding": sharding.op4_sharding,
    "op5_document_fingerprints": imatch.op5_document_fingerprints,
    "op6_exact_top_k": knn.op6_exact_top_k,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op10_token_files": tokenfile.op10_token_files,
    "op11_html_extraction": htmltext.op11_html_extraction,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_collocations": collocations.op13_collocations,
}

#: The others can't be expressed in SQL; tests/llm hold them against brute force, round trips or held-out labels.
SQL = {
    "op1_mixing": mixing.SQL,
    "op6_exact_top_k": knn.SQL,
    "op8_chat_formatting": chat.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_collocations": collocations.SQL,
}
