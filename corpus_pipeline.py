"""From raw documents to token ids: filter, deduplicate, decontaminate, mask, encode.

Each stage works on all that the one before kept, and is written before the next one reads it. All stages but the last
return the columns of documents:

- quality: documents whose score is below the classifier's threshold go;
- near_duplicates: of each group of near-duplicates the document with the least doc_id stays;
- decontaminate: documents that hold a ten-word window of the benchmark go;
- personal_data: personal data is replaced by its kind in angle brackets, n_chars is counted anew;
- tokens: doc_id, n_tokens, ids, and decoded: the text that the ids decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postwatch.llm import bpe, common, decontaminate, near_dedup, pii, quality
from postwatch.llm.queries import table

#: SQL cannot express these stages; tests/llm compares them with plain versions.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    return near_dedup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    return pii.mask(docs, pii.fit(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
