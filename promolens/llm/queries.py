"""Queries of the corpus operators, by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from promolens.llm import chat, decontam, divergence, mixing, neighbours, perplexity, personal, prefixes, secrets, shards, simhash, toxicity, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_jump_sharding": shards.op3_jump_sharding,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_format": chat.op6_chat_format,
    "op7_kneser_ney_quality": perplexity.op7_kneser_ney_quality,
    "op8_poisson_mixing": mixing.op8_poisson_mixing,
    "op9_learned_partitions": neighbours.op9_learned_partitions,
    "op10_warc_dictionary": warc.op10_warc_dictionary,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_personal_data": personal.op12_personal_data,
    "op13_conversation_trie": prefixes.op13_conversation_trie,
}

SQL = {
    "op2_decontaminate": decontam.OP2_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_poisson_mixing": mixing.OP8_SQL,
    "op10_warc_dictionary": warc.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op13_conversation_trie": prefixes.OP13_SQL,
}
