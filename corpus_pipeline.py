"""A training-corpus pipeline: quality, near-dedup, decontamination, mixing, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which the caller writes as Parquet and reads again as the next one's ``docs``. All but the last
return the columns of ``documents``; the last returns a row per document of the written token store.

Cases, the same in every stage. Further columns, whatever their names, go along unchanged. Null ids, null
and empty texts, null languages and sources are rows like others: no stage but the mix drops them, and
the mix gives a text without words as many copies as its source's target asks for. Very long texts are
taken whole. An empty table gives an empty table; empty labels reject nothing, an empty benchmark hits
nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.llm.common import SharedTables
from brightwater.llm.decontaminate import remove_contaminated
from brightwater.llm.mixing import mixed_documents
from brightwater.llm.near_dups import NearDuplicates
from brightwater.llm.quality import keep_good
from brightwater.llm.token_store import write_store

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject; copies of a row share their verdict."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return NearDuplicates(docs).survivors(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; copies of a row share their verdict."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows equal in all columns pool their copies."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents as read back, a row per document: doc_id, start, n_tokens, ids_crc32."""
    return write_store(docs, public_tokenizers.path(TOKENIZER)).digests()


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("token_ids", token_ids)]

# A language model and near-duplicate groups are beyond SQL; tests/llm holds run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    tables = SharedTables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).select(F.col("doc_id"), "start", "n_tokens", "ids_crc32")
