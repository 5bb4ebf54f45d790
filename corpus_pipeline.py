"""A corpus pipeline of five stages: toxic documents go, then exact copies, then near copies; personal data is masked; the rest is packed.

run() applies STAGES to the documents table; each stage's result is written as Parquet and read again as the next one's
input. Training labels come from the folder's labels table. SQL can't express the stages; tests hold them against
brute force.

In every stage null text counts as empty, texts of any length are whole, an empty table gives an empty result, and all
but the last return the columns they got, whatever their names. Rows are told by doc_id and text together: a repeated
doc_id with different texts is as many documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.common import documents, written
from llm.exact_dedup import deduplicated
from llm.packing import packed
from llm.pii import masked
from llm.queries import importable
from llm.simhash import near_deduplicated
from llm.toxicity import trained, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the grammar, learned from this folder's labels, doesn't call toxic: each is judged by itself, so repeated rows stay or go together; null and empty texts and null doc_ids stay."""
    return without_toxic(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the smallest doc_id (null only where all are; of rows that are equal in it, one). Null and empty texts are one text."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more in shingles of five words, the row with the smallest doc_id, of several such the one whose digest comes first, and of rows equal in both one. Texts without words are alike; rows without doc_id stay. SimHash tiles name the first candidates, prefixes of shingles all that are left."""
    return near_deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, with personal data in text replaced by its kind; null stays null."""
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; each row is packed, repeated ones too, and an empty or null text is its end mark."""
    return packed(docs)


def _staged(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return importable(lambda s, d: stage(s, docs, d))(spark, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [(f.__name__, _staged(f)) for f in (toxicity, exact_dedup, near_dedup, personal_data, packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
