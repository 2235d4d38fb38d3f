"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import centroids, crf_langid, fm_quality, license_scan, mixing, ngram_jaccard, packing, perplexity, prefix_trie, secret_ledger, sentence_pieces, syncmers, token_cache

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
    "op3_perplexity": perplexity.op3_perplexity,
    "op4_syncmers": syncmers.op4_syncmers,
    "op5_crf_langid": crf_langid.op5_crf_langid,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_fm_quality": fm_quality.op7_fm_quality,
    "op8_packing": packing.op8_packing,
    "op9_secret_scans": secret_ledger.op9_secret_scans,
    "op10_token_counts": token_cache.op10_token_counts,
    "op11_centroids": centroids.op11_centroids,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_sentence_pieces": sentence_pieces.op13_sentence_pieces,
}
SQL = {"op1_mixing": mixing.SQL, "op2_ngram_jaccard": ngram_jaccard.SQL, "op9_secret_scans": secret_ledger.SQL, "op11_centroids": centroids.SQL, "op12_prefix_trie": prefix_trie.SQL}
