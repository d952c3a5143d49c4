"""The queries opN_* over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, credentials, decontam, divergence, filteraudit, jaccard, langid, packing, quality, sharding, substrings, warc, wordpiece
from ._util import scratch, table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = wordpiece.sentencepiece_pieces(vocabulary("piece_bpe_32k.model"))
    return wordpiece.token_counts(docs, *pieces).drop("text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.when(F.col("text").isNull(), 0).otherwise(F.octet_length(text)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    return sharding.shuffle_shards(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.hits(docs, table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.col("n_hit") > 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch(spark))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identified(docs, langid.Trees(langid.training_sample(docs)))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(
        *[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
          for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    return chat.digest(chat.parse_chats(chat.format_chats(rows.unionByName(probe))))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return credentials.digest(credentials.found(docs, credentials.Formats(credentials.examples(docs))).drop("text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.diverging(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (
        op1_token_counts, op2_sharding, op3_quality, op4_repeats, op5_packing, op6_decontamination, op7_warc, op8_jaccard, op9_language, op10_chat,
        op11_secrets, op12_filter_audit, op13_divergence)
}
