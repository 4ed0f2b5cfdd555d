"""The operators of this subpackage as registered queries, with production parameters, and their DuckDB twins."""

import public_tokenizers
from pyspark.sql import functions as F

from claimweave.llm import (
    decontamination,
    language_model,
    line_dedup,
    merkle,
    mixing,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    token_counts,
    token_store,
    whitening,
)
from claimweave.llm.common import documents
from claimweave.session import scratch_dir

# Parameters that a query shares with its twin.
MIX_EPOCHS, MIX_SEED = 1.0, 11

QUERIES = {}
ORACLES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@query
def op1_fuzzy_line_dedup(spark, sf_dir):
    return line_dedup.line_report(documents(spark, sf_dir))


@query
def op2_isolation_rules(spark, sf_dir):
    return quality_rules.judge_rules(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op3_attention_mil(spark, sf_dir):
    return quality_classifier.classify(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op4_two_tier_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_poisson_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(documents(spark, sf_dir), weights=None, epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select("doc_id", "source", "n_copies", "copy", F.round("position", 12).alias("position"), "text")


@query
def op6_covering_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op7_maxent_lm(spark, sf_dir):
    return language_model.score_texts(documents(spark, sf_dir))


@query
def op8_elias_fano_store(spark, sf_dir):
    path = scratch_dir(spark, "token-store")
    token_store.write_token_store(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_digests(spark, path)


@query
def op9_deobfuscated_pii(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


@query
def op10_containment_search(spark, sf_dir):
    return decontamination.contained_items(documents(spark, sf_dir), benchmark(spark, sf_dir))


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle.tamper_report(documents(spark, sf_dir))


@query
def op12_jump_sharding(spark, sf_dir):
    return sharding.shard_report(documents(spark, sf_dir))


@query
def op13_multiplicity_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
