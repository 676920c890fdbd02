"""Queries of this subpackage and, where SQL can express them, what they must equal."""

from wayside.llm import ann, bpe, langid, lm, mixing, neardup, periodic, quality, secretscan, tokencount, trie, urls, wordshuffle

QUERIES = {
    "op1_pseudo_likelihood": lm.op1_pseudo_likelihood,
    "op2_host_reputation": urls.op2_host_reputation,
    "op3_language": langid.op3_language,
    "op4_bpe": bpe.op4_bpe,
    "op5_mix": mixing.op5_mix,
    "op6_host_rules": quality.op6_host_rules,
    "op7_nearest": ann.op7_nearest,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_secret_spans": secretscan.op10_secret_spans,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_distinct_words": wordshuffle.op13_distinct_words,
}

ORACLE_SQL = {
    "op2_host_reputation": urls.ORACLE,
    "op5_mix": mixing.ORACLE,
    "op6_host_rules": quality.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
}
