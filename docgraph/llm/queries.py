"""The queries of the ten operators, over whole tables and with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgraph.llm import decontaminate, mixing, pii, rabitq, recompress, repeats, secrets, simhash, suffix, toxicity, warc
from docgraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of its class of near copies."""
    return simhash.classes(table(spark, sf_dir, "documents"))


def op5_rabitq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"))


def rabitq_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 where there is something to find: near copies of a tenth of the vectors are added."""
    return rabitq.near_duplicates(rabitq.perturbed(table(spark, sf_dir, "embeddings")))


def op6_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op3_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeated_substrings(table(spark, sf_dir, "documents"))


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold one replica; the other is made by warc.damaged."""
    pages = table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged(pages))


def op10_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_bktree,
        op2_suffix_radix_dedup,
        op3_randomness_secrets,
        op4_recompression_dedup,
        op5_rabitq_embeddings,
        op6_sainte_lague_mixing,
        op7_string_kernel_toxicity,
        op8_latent_decontamination,
        op9_warc_merkle_fixity,
        op10_bilstm_crf_pii,
        rabitq_near_copies,
    )
}
ORACLES: dict[str, str] = {
    "op2_suffix_radix_dedup": repeats.oracle(),
    "op4_recompression_dedup": repeats.oracle(),
    "op5_rabitq_embeddings": rabitq.oracle(),
    "rabitq_near_copies": rabitq.oracle(rabitq.PERTURBED),
    "op6_sainte_lague_mixing": mixing.oracle(),
    "op9_warc_merkle_fixity": warc.oracle(),
}
