"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, maxscore, minhash, mixing, quality, sharding, simhash, substrings, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_substrings": substrings.query,
        "op3_maxscore": maxscore.query,
        "op4_simhash": simhash.query,
        "op5_bpe": bpe.query,
        "op6_minhash": minhash.query,
        "op7_mixing": mixing.query,
        "op8_quality": quality.query,
        "op9_sharding": sharding.query,
        "op10_urls": urls.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_maxscore": maxscore.ORACLE, "op7_mixing": mixing.ORACLE, "op9_sharding": sharding.ORACLE}
