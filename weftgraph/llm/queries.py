"""Queries of the training-data operators over the driver's tables.

Each applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scores import learn, scores

    docs = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))  # a null id is no remainder of 2
    return scores(docs, learn(docs.filter(~held_out), common.tokenizer_path("piece_bpe_32k.model")), held_out)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import drawn_findings, secrets, train

    return secrets(common.table(spark, sf_dir, "documents"), train(drawn_findings(spark)))


def op3_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    found = contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", "similarity")


#: The setting that holds the secret key of pseudonyms.
KEY_SETTING = "spark.weftgraph.pseudonyms.key"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of KEY_SETTING; without one, a random key that is forgotten with the run."""
    import secrets as random_keys

    from .pseudonyms import pseudonymised

    key = spark.conf.get(KEY_SETTING, None) or random_keys.token_hex(32)
    found = pseudonymised(common.table(spark, sf_dir, "documents"), key)
    return found.select("doc_id", "text", F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f.kind, f.pseudonym)), " ").alias("pseudonyms"), "n_replaced")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _remainder(divisor: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, toxicity

    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").filter(_remainder(3) != 1)
    found = toxicity(docs, learn(docs, labels))
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    found = quality(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_scores, op2_secret_scan, op3_minhash_near_dups, op4_decontamination, op5_pseudonyms, op6_token_counts, op7_source_mixing, op8_toxicity, op9_quality_rules, op10_token_files)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
