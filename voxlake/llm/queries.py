"""The registered queries of the text operators; every one runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

BPE_FILE = "byte_bpe_50k.json"
UNIGRAM_FILE = "piece_bpe_32k.model"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.url_filter import RULES, judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.packing import pack_documents

    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(BPE_FILE))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.token_bin import token_files_round_trip

    return token_files_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(BPE_FILE))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.quality_rules import quality_verdicts

    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.warc import archive_round_trip

    out = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.line_dedup import drop_boilerplate

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_boilerplate(docs, docs["source"]).select("row.doc_id", "text", "n_lines", "n_removed")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.decontam import contamination

    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.quality_cnn import quality_scores

    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.llm.token_count import token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(UNIGRAM_FILE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_best_fit_packing, op3_token_files, op4_quality_rules, op5_warc_bundles, op6_line_dedup, op7_decontamination, op8_quality_network, op9_token_counts, op10_simhash_components,)}


def oracle_sql() -> dict[str, str]:
    from voxlake.llm import line_dedup, warc

    return {"op5_warc_bundles": warc.ORACLE, "op6_line_dedup": line_dedup.ORACLE}
