"""The queries of this subpackage by name, and the SQL that some are compared with."""

from memlake.llm import bpe, compression_rules, conversation_repair, embedding_dedup, exact_dedup, language_id, mixing, near_dedup, quality, secrets, sharding, spelling, substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_count_min_windows,
        language_id.op2_ftrl_language,
        exact_dedup.op3_golomb_exchange,
        secrets.op4_secret_spans,
        near_dedup.op5_prob_minhash,
        mixing.op6_source_mix,
        sharding.op7_rendezvous_shards,
        bpe.op8_bpe_round_trip,
        embedding_dedup.op9_rotated_codes,
        quality.op10_bradley_terry,
        compression_rules.op11_compression_bands,
        spelling.op12_fm_spelling,
        conversation_repair.op13_checkpointed_repair,
    )
}

ORACLE = {**exact_dedup.ORACLE, **mixing.ORACLE, **conversation_repair.ORACLE}
