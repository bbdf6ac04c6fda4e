"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from steelyard.llm.bytepairs import op11_byte_pairs
from steelyard.llm.codes import SQL_OP13, op13_codes
from steelyard.llm.embeddings import SQL_OP4, op4_embeddings
from steelyard.llm.minhash import SQL_OP3, op3_minhash
from steelyard.llm.mixing import SQL_OP8, op8_mixing
from steelyard.llm.packing import op1_packing
from steelyard.llm.pii import op7_pii
from steelyard.llm.quality_model import op10_quality_model
from steelyard.llm.quality_rules import SQL_OP6, op6_quality_rules
from steelyard.llm.sharding import op9_sharding
from steelyard.llm.suffixes import SQL_OP5, op5_suffixes
from steelyard.llm.tokencount import op2_token_counts
from steelyard.llm.variants import SQL_OP12, op12_variants

QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_minhash": op3_minhash,
    "op4_embeddings": op4_embeddings,
    "op5_suffixes": op5_suffixes,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_quality_model": op10_quality_model,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_variants": op12_variants,
    "op13_codes": op13_codes,
}
ORACLE_SQL = {
    "op5_suffixes": SQL_OP5,
    "op3_minhash": SQL_OP3,
    "op4_embeddings": SQL_OP4,
    "op6_quality_rules": SQL_OP6,
    "op8_mixing": SQL_OP8,
    "op12_variants": SQL_OP12,
    "op13_codes": SQL_OP13,
}
