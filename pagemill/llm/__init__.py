"""Operators of a training-data pipeline over tables of documents, pages and conversations.

words, arrow    helpers: words of texts as arrays, Arrow batches in and out
quality         divergence of character and word histograms from language references
near_dedup      SuperMinHash, banding, exact verification, union-find
decontaminate   SimHash of item-sized windows, multi-index Hamming search, exact verification
mixing          Efraimidis-Spirakis sampling to token budgets
suffix_dedup    run-length index of anchored text, matching statistics, removal of long matches
token_output    token ids in Arrow files of fixed-size lists
html_extract    consensus container paths per host
url_filter      accepted/rejected character models of URLs
classifier      ordinal cumulative-link regression
chat            budgeted, turn-aligned windows of conversations
conversation_repair  cheapest repair of turn structure over a Re-Pair grammar
token_counts    counts of piece tokens by merging in step
conversation_trie  prefix trie by van Emde Boas recursion
digests         helper: SHA-256 of long lists of texts
queries         the registered queries and their SQL
"""
