"""Queries of the operators and their SQL."""

from veilgram.llm import chat, decontaminate, html_tree, line_dedup, lm_score, merkle, mixing, phrases, pieces, quality, shard, simhash, target_encoding

QUERIES = {
    "op1_lm_score": lm_score.query,
    "op2_line_dedup": line_dedup.query,
    "op3_simhash": simhash.query,
    "op4_quality": quality.query,
    "op5_decontaminate": decontaminate.query,
    "op6_html_text": html_tree.query,
    "op7_merkle": merkle.query,
    "op8_mixing": mixing.query,
    "op9_shard": shard.query,
    "op10_chat_format": chat.query,
    "op11_phrases": phrases.query,
    "op12_pieces": pieces.query,
    "op13_target_encoding": target_encoding.query,
}
ORACLES = {"op1_lm_score": lm_score.SQL, "op2_line_dedup": line_dedup.SQL, "op8_mixing": mixing.SQL, "op9_shard": shard.SQL, "op10_chat_format": chat.SQL, "op11_phrases": phrases.SQL, "op13_target_encoding": target_encoding.SQL}
