"""The queries op1 to op13: each applies its operator to the whole of its table.

Tokenizer files: parameters of the operators; these queries take them from the
installed package `public_tokenizers`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import alignment, gif, licences, lm, neardup, ngramjoin, packing, piecebpe, quality_knn, quality_rules, toxicity, warc, whitening
from docframe.llm.arrowmap import shared_dir
from docframe.llm.labelled import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, model), 0.5, "llr")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = gif.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    feature = F.concat_ws(":", "n_frames", "duration_ms", F.array_join(F.transform("histogram", lambda n: n.cast("string")), ","))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    archives = warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, _table(spark, sf_dir, "labels"))
    return _scored(quality_knn.score(docs, model), 0.3, "nearest")


def _scored(df: DataFrame, cut: float, *more: str) -> DataFrame:
    return df.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *more)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.where(fold("doc_id", 7) != 2), shared_dir(spark))
    columns = ("n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    return lm.score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), *columns)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.expr(licences.PATH_SQL.format(div="div")).alias("path"), "text")
    return licences.scan(files, keep=("doc_id",))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piecebpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), columns=("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.linked(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    made = whitening.whiten(rows, whitening.fit(rows))
    return made.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_near_dedup": op6_near_dedup,
    "op7_gif_media": op7_gif_media,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_ngram_join": op11_ngram_join,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op3_license_scan": licences.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
}
