"""Exact token-length histogram, and what it answers for every context limit.

Documents are encoded once and only their lengths are counted. The histogram has a row per distinct
length; suffix sums over it give, for each length L taken as a context limit, how many documents fit,
how many are cut, the tokens that remain when every document is cut at L, and the quantile L stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeforge.llm.arrow_text import slices, texts_of
from routeforge.llm.library_bpe import encoder_for
from routeforge.session import stage_table

#: Lengths per block of the two-level sums: one window runs inside blocks, one over block totals.
BLOCK = 1024


def length_histogram(docs: DataFrame, spec: str) -> DataFrame:
    """(length, n_docs) over every row's whole text. Null text has length 0; an empty table gives no row.

    Each task sums its own counts first, so the shuffle has at most a row per task and length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value)
        for table in slices(batches, "text"):
            lengths, n = np.unique(np.diff(encoder.encode(texts_of(table)).starts), return_counts=True)
            yield pa.record_batch([pa.array(lengths, pa.int64()), pa.array(n, pa.int64())], ["length", "n"])

    counted = docs.select("text").mapInArrow(count, "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def for_every_limit(histogram: DataFrame) -> DataFrame:
    """One row per length taken as the limit:

    n_docs (of that length), tokens (in them), docs_within (that length or shorter), docs_cut (longer),
    tokens_within, truncated_total (tokens left when each document is cut at the limit), tokens_lost, and
    quantile (the share of documents that fit).
    """
    # The histogram is read three times; written out, the documents are encoded once.
    histogram = stage_table(histogram, "length-histogram")
    rows = histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn(
        "block", F.floor(F.col("length") / BLOCK)
    )
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # A row per 1024 lengths: as many as the longest document has thousands of tokens.
    above = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_above"),
    )
    totals = blocks.agg(F.sum("block_docs").alias("all_docs"), F.sum("block_tokens").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = (
        rows.withColumn("docs_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
        .withColumn("tokens_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(above, "block")
        .crossJoin(F.broadcast(totals))  # one row
    )
    cut = F.col("docs_above") + F.col("docs_in")
    lost_from = F.col("tokens_above") + F.col("tokens_in")
    return joined.select(
        "length",
        "n_docs",
        "tokens",
        (F.col("all_docs") - cut).alias("docs_within"),
        cut.alias("docs_cut"),
        (F.col("all_tokens") - lost_from).alias("tokens_within"),
        (F.col("all_tokens") - lost_from + F.col("length") * cut).alias("truncated_total"),
        (lost_from - F.col("length") * cut).alias("tokens_lost"),
        ((F.col("all_docs") - cut) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for given limits, whether a document has that length or not: limit, docs_cut, truncated_total."""
    asked = [F.struct(F.lit(int(n)).cast("long").alias("limit")) for n in limits]
    paired = histogram.select("length", "n_docs", F.explode(F.array(*asked)).alias("a")).select("*", "a.limit")
    return paired.groupBy("limit").agg(
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_total"),
    )
