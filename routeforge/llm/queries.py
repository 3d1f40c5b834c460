"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeforge.llm import (
    bpe,
    contamination,
    decision_list,
    html_extraction,
    line_dedup,
    lsh_forest,
    parity_join,
    secrets,
    sharding,
    spelling,
    token_counts,
    token_files,
    whitening,
)
from routeforge.llm.library_bpe import read_spec

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SHARDS = 40


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spec() -> str:
    return read_spec(public_tokenizers.path(VOCABULARY))


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, folder, "documents"), _spec(), END_ID)
    return token_files.read_token_files(spark, manifest)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))))
    n_hit = F.expr("CAST(aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.first) AS long)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = decision_list.judge_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    decided = line_dedup.line_decisions(_table(spark, folder, "documents"))
    return decided.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.contiguous_shards(_table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity_join.near_duplicates(_table(spark, folder, "documents")).drop("keeps", "text_hash")


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs, spec = _table(spark, folder, "documents"), _spec()
    return bpe.encode_and_decode(docs, spec, bpe.ship_lexicon(docs, spec))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.for_every_limit(token_counts.length_histogram(_table(spark, folder, "documents"), _spec()))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.main_texts(_table(spark, folder, "pages"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    fitted = whitening.fit_whitening(rows)
    n, shares, error = (fitted.n, fitted.explained.tolist(), fitted.identity_error) if fitted else (0, [], 0.0)
    each = whitening.whiten(rows, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(v) for v in shares]).cast("array<double>")
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    found = lsh_forest.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, folder, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_html_extraction": op10_html_extraction,
    "op11_whitening": op11_whitening,
    "op12_lsh_forest": op12_lsh_forest,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE: dict[str, str] = {}
