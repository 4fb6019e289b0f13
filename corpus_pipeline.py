"""From raw documents to token files in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``:

1. quality rules: rows that break a rule go;
2. MinHash near-duplicates (five words, similarity 0.8): of each group the
   document with the least id stays;
3. benchmark decontamination: documents that hold a benchmark passage go;
4. mixing: documents come as often as the mix takes them;
5. token files: the rows read back from the wavelet matrices,
   ``doc_id, start, n_tokens, ids_crc32``.

Null texts are empty and fail the quality rules.  Rows with a null id are
linked with nothing and go on by their text; repeated rows of a kept id all
stay; further columns, whatever their names, go through to the mixed table; an
empty table gives no row.  Whole texts of any length are read at every stage.

SQL cannot express the MinHash components, the budget fitting and the
tokenizer, so ORACLE_SQL is None; tests compare ``run`` with a brute-force
version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import common
from weftgraph.llm.decontamination import keep_clean
from weftgraph.llm.mixing import mixture
from weftgraph.llm.near_dups import keep_first
from weftgraph.llm.quality import keep_good
from weftgraph.llm.token_files import token_files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs, common.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", minhash_near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", mix_sources),
    ("token output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
