"""Queries of this subpackage and the SQL that checks them."""

from retort.llm import chat, lexical, mixing, nearest, ngram_join, pieces, pii, repeats, secrets, token_counts, topk, toxicity, whitening

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard,
    "op2_mixing": mixing.op2_mixing,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_pii": pii.op8_pii,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_nearest_neighbours": nearest.op10_nearest_neighbours,
    "op11_substring_dedup": repeats.op11_substring_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_lexical_search": lexical.op13_lexical_search,
}
#: Where SQL can express the whole result; the others are tested against brute force.
ORACLES: dict[str, str] = {"op2_mixing": mixing.OP2_SQL, "op4_chat_formatting": chat.OP4_SQL, "op6_exact_top_k": topk.OP6_SQL, "op10_nearest_neighbours": nearest.OP10_SQL, "op11_substring_dedup": repeats.OP11_SQL, "op13_lexical_search": lexical.OP13_SQL}
