"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vantage.llm import decontaminate, htmltext, langid, mixing, neargraph, secrets, sharding, simhash, surrogates, tokenfile


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        sharding.op1_sharding,
        langid.op2_language_id,
        surrogates.op3_pii_surrogates,
        htmltext.op4_html_extraction,
        neargraph.op5_embedding_near_dedup,
        secrets.op6_secret_scan,
        decontaminate.op7_benchmark_decontamination,
        mixing.op8_mixing_sources,
        simhash.op9_simhash_near_dedup,
        tokenfile.op10_token_output,
        # of op1 and op5 again, where shards have to split and vectors have to link
        sharding.small_shards,
        neargraph.planted_links,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express. The others are tested against brute force, round trips or held-out accuracy."""
    return {"op1_sharding": sharding.shard_sql(), "op5_embedding_near_dedup": neargraph.near_links_sql(), "op7_benchmark_decontamination": decontaminate.decontamination_sql(), "op8_mixing_sources": mixing.mixing_sql(), "small_shards": sharding.shard_sql(sharding.SMALL), "planted_links": neargraph.planted_links_sql()}
