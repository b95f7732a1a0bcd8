"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import audio, centroids, decontaminate, langid, lines, mixing, neardup, quality, repeats, secrets, spelling, tokencounts, toxicity
from corpusloom.llm.arrow import held_out
from corpusloom.llm.neardup import NearDupConfig
from corpusloom.llm.spelling import SpellingConfig
from corpusloom.session import table


def op1_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), NearDupConfig(words=4))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and of the operator's media and tensors: the segments and a hash of the tensors."""
    kept = audio.audio_columns(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.sha2("media", 256).alias("media_sha256"), "feature", F.sha2("tensors", 256).alias("tensors_sha256"), "segments")


def op3_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op5_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.lang, s.first_word.cast("string"), s.n_words.cast("string"))), ",")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", spans.alias("spans"))


def op6_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.count_lines(table(spark, sf_dir, "documents"))


def op8_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(table(spark, sf_dir, "documents"))


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = spark.conf.get("spark.corpusloom.vocabulary", tokencounts.VOCABULARY)  # the path is the session's to set
    return tokencounts.token_length_table(spark, table(spark, sf_dir, "documents"), vocabulary)


def op10_combined_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op11_deletion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"), SpellingConfig(noise=31))


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.lloyd(table(spark, sf_dir, "embeddings")).drop("centroid", "n_cluster")


def op13_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "word")


QUERIES = (
    op1_odd_sketch_dedup, op2_audio_features, op3_suffix_automaton, op4_pairwise_quality, op5_script_viterbi, op6_sainte_lague, op7_fuzzy_lines,
    op8_difference_cover, op9_length_histogram, op10_combined_automaton, op11_deletion_keys, op12_dual_tree_lloyd, op13_subsequence_svm,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from corpusloom.llm.oracles import ORACLES

    return dict(ORACLES)
