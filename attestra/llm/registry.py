"""The queries of this package and their SQL, by name."""

from attestra.llm import ann, chat, fingerprints, lines, manifest, middle, mixing, pieces, setjoin, sharding, suffix_tree, toxicity, urls

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_ann": ann.op5_ann,
    "op6_suffix_tree": suffix_tree.op6_suffix_tree,
    "op7_ngram_jaccard": setjoin.op7_ngram_jaccard,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": urls.op9_url_filter,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_line_dedup": lines.op11_line_dedup,
    "op12_fill_in_middle": middle.op12_fill_in_middle,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}
ORACLE = {
    "op1_chat_format": chat.SQL,
    "op7_ngram_jaccard": setjoin.SQL,
    "op9_url_filter": urls.SQL,
    "op11_line_dedup": lines.SQL,
    "op12_fill_in_middle": middle.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
