"""Registered queries of the training-data operators, and SQL for those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.session import scratch_path

from . import (decontaminate, kneser_ney, language_id, license_scan, mixing, ngram_join, quality_fm, quality_rules, resampling, spelling_variants,
               token_counts, url_rules, warc)
from .common import held_out, load, prepare

#: Columns besides the text that the quality classifier may look at.
QUALITY_METADATA = ("n_chars",)
TOKENIZER = "piece_bpe_32k.model"
#: The contract's rules (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of links of every document at a shingle similarity of 0.8."""
    prepare(spark)
    return ngram_join.groups(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document from a model that never saw the held-out quarter."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    model = language_id.train(docs, use=~held_out(F.col("doc_id"), 4, 2))
    return language_id.identify(docs, model, spans=False).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op3_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    prepare(spark)
    return mixing.taken(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive of all pages says of every record when it is read back."""
    prepare(spark)
    path = scratch_path(spark, "warc")
    warc.write_archive(load(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item, by document and item."""
    prepare(spark)
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    prepare(spark)
    import public_tokenizers
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every whole document."""
    prepare(spark)
    return license_scan.scan(load(spark, sf_dir, "documents"))


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from a model that never saw the held-out fifth."""
    prepare(spark)
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = quality_fm.fit(docs, labels, use=~held_out(F.col("_id"), 5, 0), metadata=QUALITY_METADATA)
    scored = quality_fm.score(docs, model, metadata=QUALITY_METADATA)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a model of nine tenths of them."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    model = kneser_ney.train(docs, use=~held_out(F.col("doc_id"), 10, 0), order=kneser_ney.ORDER)
    return kneser_ney.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 10, 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and weak-supervision verdict of every document."""
    prepare(spark)
    return quality_rules.score(load(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", "posterior")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw that resembles the benchmark."""
    prepare(spark)
    return resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest fitting rule and verdict of every page's url."""
    prepare(spark)
    return url_rules.judge(load(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word, with a letter left out of some of the runs."""
    prepare(spark)
    return spelling_variants.group_variants(load(spark, sf_dir, "documents"), drop_every=199)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_language_id, op3_weighted_fair_mix, op4_warc_archive, op5_decontaminate, op6_token_counts,
                                    op7_license_scan, op8_quality_fm, op9_kneser_ney, op10_quality_rules,
                                    op11_importance_resampling, op12_url_rules, op13_spelling_variants,
                                    pipeline)}


def llm_oracles() -> dict[str, str]:
    from .oracles import ORACLES
    return dict(ORACLES)
