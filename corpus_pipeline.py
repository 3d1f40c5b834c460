"""The corpus pipeline: documents through quality rules, line dedup, near duplicates, decontamination and encoding.

Every stage takes (spark, docs, sf_dir) and returns what its successor reads; all but the last return the columns of documents, whatever
their names.
run() writes each stage's rows to the shared folder and reads them again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeforge.llm import bpe, contamination, decision_list, line_dedup, parity_join
from routeforge.llm.library_bpe import read_spec
from routeforge.llm.rows import packed, unpacked
from routeforge.session import stage_table

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = decision_list.judge_quality(packed(docs), labels, keep=("doc_id", "text", "rest"))
    return unpacked(judged.where("kept"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of equal or similar lines stays; documents left without words go."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: documents link at 0.8 of their word 5-shingles."""
    return parity_join.one_of_each(docs, percent=80, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.find_contamination(packed(docs), benchmark, keep=("doc_id", "text", "rest"))
    return unpacked(found.where(F.size("hit_spans") == 0), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts, beside the columns that documents have besides the text; a column of such a name gives
    way to the new one."""
    spec = read_spec(public_tokenizers.path(VOCABULARY))
    encoded = bpe.encode_and_decode(packed(docs), spec, bpe.ship_lexicon(docs, spec), keep=("doc_id", "rest"))
    kept = [c for c in docs.columns if c.lower() not in ("text", *bpe.RESULTS)]
    return encoded.select(*[F.col(c) if c == "doc_id" else F.col("rest").getField(c).alias(c) for c in kept], *bpe.RESULTS)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Learned rules, similarity and byte-pair merges have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None
