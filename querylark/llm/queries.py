"""Registry of this subpackage's queries: opN_<name> and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import gridjoin, linededup, minhash, packing, pieces, pii, quality, sharding, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": minhash.op1_minhash,
    "op2_topk": topk.op2_topk,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_linededup": linededup.op5_linededup,
    "op6_pieces": pieces.op6_pieces,
    "op7_pii": pii.op7_pii,
    "op8_packing": packing.op8_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_gridjoin": gridjoin.op10_gridjoin,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": topk.SQL,
    "op5_linededup": linededup.SQL,
    "op9_sharding": sharding.SQL,
}
