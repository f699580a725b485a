"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline

from . import align, bpe, exact_dedup, mixing, ngram, pii, quality, simhash, token_files, topk, toxicity, trie, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_topk": topk.op3_topk,
    "op4_simhash": simhash.op4_simhash,
    "op5_ngram": ngram.op5_ngram,
    "op6_pii": pii.op6_pii,
    "op7_mixing": mixing.op7_mixing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality": quality.op9_quality,
    "op10_token_files": token_files.op10_token_files,
    "op11_warc": warc.op11_warc,
    "op12_align": align.op12_align,
    "op13_trie": trie.op13_trie,
}

ORACLE_SQL = {
    "op3_topk": topk.OP3_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_warc": warc.OP11_SQL,
    "op13_trie": trie.OP13_SQL,
}
