"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, collocations, exact_dedup, merkle, neighbours, ngram_join, packing, passages, quotes, secrets, sentencepiece_codec, sharding, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_quotes": quotes.op4_quotes,
    "op5_secrets": secrets.op5_secrets,
    "op6_sharding": sharding.op6_sharding,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": packing.op8_packing,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_passages": passages.op10_passages,
    "op11_merkle": merkle.op11_merkle,
    "op12_collocations": collocations.op12_collocations,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}
SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op2_ngram_join": ngram_join.OP2_SQL, "op10_passages": passages.OP10_SQL, "op11_merkle": merkle.OP11_SQL, "op12_collocations": collocations.OP12_SQL}
