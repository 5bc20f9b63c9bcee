"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, hard_negatives, imatch, language_id, mixing, near_dedup, nn_descent, packing, resampling, sharding, substring_dedup, url_filter, warc
from .oracles import ORACLES

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_warc": warc.op2_warc,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_packing": packing.op4_packing,
    "op5_mixing": mixing.op5_mixing,
    "op6_imatch": imatch.op6_imatch,
    "op7_nn_descent": nn_descent.op7_nn_descent,
    "op8_language_id": language_id.op8_language_id,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_resampling": resampling.op11_resampling,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_bpe": bpe.op13_bpe,
}
ORACLE_SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}
