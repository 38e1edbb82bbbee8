"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import audio, fingerprints, merge_dropout, near_duplicates, packing, pii, quality, token_store, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_near_duplicates": near_duplicates.op3_near_duplicates,
    "op4_warc_packages": warc.op4_warc_packages,
    "op5_token_store": token_store.op5_token_store,
    "op6_surrogates": pii.op6_surrogates,
    "op7_quality": quality.op7_quality,
    "op8_merge_dropout": merge_dropout.op8_merge_dropout,
    "op9_audio_features": audio.op9_audio_features,
    "op10_packing": packing.op10_packing,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": url_filter.OP2_SQL, "op3_near_duplicates": near_duplicates.OP3_SQL, "op4_warc_packages": warc.OP4_SQL}
