"""A training corpus from raw documents: five stages, each an operator of docgraph.llm over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the cluster's shared
folder and hands the next stage what it reads back, so that a lost executor never costs more than the stage at hand.

Of all stages: an empty table stays one; rows that repeat an id or a text are judged each (but see near duplicates);
very long texts are read whole; further columns, whatever their names, stay as they are up to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgraph.llm import decontaminate, mixing, secrets, simhash, toxicity
from docgraph.llm.common import delete_folder, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine, trained on ``labels``, rejects go.

    Null, empty and wordless texts stay, whatever their id. A score at the threshold is not rejected. With no toxic or
    no clean label nothing is rejected.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; rows that repeat that id stay all.

    Documents with a null id, a null text or no word belong to no group and stay.
    """
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark``, or a paraphrase of one, go, also those with a null id.

    Null and empty texts stay. Items with a null and those under five words match nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark; every document stays. Null and empty texts stay null and empty."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(source, shard, block, doc_id, start_token, end_token, text): the corpus, as the parts of documents in its blocks.

    Sources have equal weights, a null source counts as "unknown". Null ids, null texts and texts without a word are in
    no block.
    """
    return mixing.mixed_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The learned stages can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``; the last one's rows are read back from the shared folder.

    Each stage's files are removed when the next stage's are written.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
