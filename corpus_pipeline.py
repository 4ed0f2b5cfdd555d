"""A training corpus out of raw documents: five stages, each one operator of `claimweave.llm` over all that the stage before kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import decontamination, mixing, quality_classifier, simhash, token_store
from claimweave.llm.common import documents
from claimweave.session import materialize, scratch_dir

#: Every source gets the same share of the mix, and the mix has as many characters as the documents that come in.
MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED = None, 1.0, 11
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, predicts to be of quality 1."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn for its source's target, in random order."""
    return mixing.mix_sources(docs, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED).select(*docs.columns)


def store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and reads back, for each copy, its place in them and the crc32 of its ids."""
    path = scratch_dir(spark, "token-store")
    token_store.write_token_store(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_store.read_digests(spark, path)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix),
    ("token store", store),
]

#: SQL has neither the classifier nor the tokenizer; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
