"""The dealt operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import curriculum, decontamination, jaccard, licenses, packing, periodic, phrases, quality, ranked, secrets, sql, tokencounts, tokenfiles, tokens, toxicity
from cohortline.llm.registry import query, table
from cohortline.session import materialize, scratch_path


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select(
        "doc_id", *[F.col(f"judged.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                   "base_failed", "kept", "rule")])


@query("op1_sum_of_squares_packing")
def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


@query("op2_secret_links")
def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query("op5_prefix_decontamination", sql.DECONTAMINATION)
def op5_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencounts.counted(table(spark, sf_dir, "documents"), tokens.default_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op3_rans_token_files")
def op3_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, tokens.default_path("byte_bpe_50k.json"))
    return tokenfiles.digest(spark, path)


@query("op6_repeated_phrases")
def op6_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.without_repeats(table(spark, sf_dir, "documents"))


@query("op8_nearest_toxicity")
def op8_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.held_out(F.col("doc_id"))
    scores = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda k: ~toxicity.held_out(k))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


@query("op4_conditional_licenses")
def op4_conditional_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.digest(periodic.periodic(docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))))


@query("op11_curriculum_mix", sql.CURRICULUM)
def op11_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(table(spark, sf_dir, "documents"), lambda s: curriculum.cycled(s, curriculum.FALLING_RISING_STEADY))
    return curriculum.digest(materialize(mixed))


@query("op12_ranked_search", sql.RANKED)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
