"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of `documents`; n_chars follows the text. Documents with a null doc_id are
never taken for copies or leaks of others. Where doc_ids repeat, the near-duplicate stage keeps one row of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lines, sentencepieces, simhash, toxicity
from tessera.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest window scores 0.5 or more go. Every row is judged by its own text, null and empty ones as an empty window."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, net).filter("toxicity_score < 0.5").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of lines that stand in an earlier place are taken out of the texts; every document stays."""
    out = lines.without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed_pieces") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles, of a Jaccard similarity of 0.8 or fingerprints within five bits, that with the smallest doc_id stays.

    The doc_ids that stay are nearly all: the join is dealt by key, as dropDuplicates is, and never goes through the driver.
    """
    parts = simhash.near_duplicates(docs, words=5, bits=5, least=0.8)
    first = parts.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.hint("merge").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null")).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, with all rows of their doc_id; rows without doc_id stay."""
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids and the text decoded from these, row by row; null and empty texts have no ids and decode to an empty text."""
    path = sentencepieces.model_path()
    return sentencepieces.decoded(sentencepieces.encoded(docs, path), path)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("simhash near-dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("sentencepiece", encode)]

#: SQL can express neither the network nor the fingerprints; tests/llm/test_pipeline.py checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
