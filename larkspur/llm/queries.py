"""The queries of this subpackage's operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontam, htmltext, idfile, langid, ordinal, rules, sampling, simhash, tokencount, toxicity
from larkspur.llm.common import key_share, table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model")
    model = langid.fit(docs, path, key_share("doc_id", 3) != 1)
    found = langid.identify(docs.select("doc_id", "text"), path, model)
    return found.select("doc_id", (key_share("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.id_file(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end=2)


def op3_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.segmentations(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"), k=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of quality 0, 1 of quality 1 but toxic, 2 of quality 1; selected: P(grade >= 1) of 0.5 or more.

    As for op6, rows whose crc32 modulo 5 is 0 are held out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = table(spark, sf_dir, "labels").withColumn("grade", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2))
    model = ordinal.fit(docs, ratings, learn_from=key_share("doc_id", 5) != 0)
    found = ordinal.score(docs, model)
    return found.select("doc_id", (key_share("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), key_share("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (key_share("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokencount.token_counts(docs, vocabulary_path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language, op2_token_ids, op3_segmentations, op4_quality, op5_simhash, op6_toxicity, op7_token_counts, op8_html_text, op9_decontamination, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    """None of these queries is within SQL: models, hashes, vocabularies or html are in each."""
    return {}
