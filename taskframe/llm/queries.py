"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskframe.llm import (
    alignment, bpe_codec, classifier, licenses, lm_scoring, nnls_packing, packing, pii, quality_rules, simhash, spelling,
    token_counts, topk,
)
from taskframe.llm.frames import read
from taskframe.llm.oracles import TOP_K_SQL, quality_rules_sql

SEQUENCE, END_ID, WINDOW_END_ID = 4096, 1, 2
TOKEN_LIMIT = 1024
QUERY_STEP, TOP = 50, 5
LM_PARTS = 10
SHINGLE, DIFFERING_BITS = 3, 2
HOLDOUT_PARTS, QUALITY_CUTOFF = 5, 0.3
SLIP_MODULUS = 199


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(df: DataFrame) -> DataFrame:
    cut = packing.pieces(df.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), SEQUENCE, END_ID)
    digested = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digested, SEQUENCE).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the model and the unigram base."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % LM_PARTS == 0
    # A null id has no checksum; such rows are learned from.
    documents = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "held_out", F.coalesce(held_out, F.lit(False)))
    scored = lm_scoring.score(documents, ~F.col("held_out"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.judge(documents, read(spark, sf_dir, "labels"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def passing_rules(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects."""
    return quality_rules.judge(df, labels).where("kept").select(df.columns)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return packed(read(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    embeddings = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(embeddings, F.col("vec_id") % QUERY_STEP == 0, TOP)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of the text they decode to."""
    path = tokenizer_path("byte_bpe_50k.json")
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.encode(documents, path, decoded="decoded").select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.taskframe.pseudonym.key", "an example key: set your own")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised, and counts by kind."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(documents, pseudonym_key(spark))


def without_personal_data(df: DataFrame) -> DataFrame:
    """The documents with pseudonyms; n_chars, if there, follows the text."""
    made = pii.pseudonymise(df, pseudonym_key(df.sparkSession)).select(df.columns)
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.length("text").cast(kind))
    return made


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(documents, tokenizer_path("byte_bpe_50k.json"), TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: four of five, by a checksum of the id."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HOLDOUT_PARTS != 0)


def with_quality(df: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    return classifier.score(df, training_labels(labels), carry=carry).withColumn(
        "predicted", (F.col("score") >= QUALITY_CUTOFF).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from labels outside the held-out fifth."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HOLDOUT_PARTS == 0
    scored = with_quality(documents, read(spark, sf_dir, "labels"), carry=["doc_id"])
    # A null id has no checksum; nothing is learned from it, as it has no label.
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(documents, shingle=SHINGLE, bits=DIFFERING_BITS)
    return found.select("doc_id", "fingerprint", "component_id")


def without_duplicates(df: DataFrame) -> DataFrame:
    """One document of each near-duplicate group."""
    found = simhash.near_duplicates(df, shingle=SHINGLE, bits=DIFFERING_BITS)
    return found.where("is_first").select(df.columns)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of every document, one row each; documents without any give none."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(documents).select("doc_id", F.explode("licenses").alias("x"))
    return found.select("doc_id", "x.license", "x.line", "x.saving", "x.differences", "x.wording")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.with_counts(documents, *paths).select("doc_id", *alignment.NAMES)


def op12_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in windows of up to 4096 tokens."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = nnls_packing.pack(documents, tokenizer_path("word_bpe_49k.json"), SEQUENCE, WINDOW_END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words, their near words and the forms they are variants of."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = spelling.word_counts(documents, "doc_id", modulus=SLIP_MODULUS)
    return spelling.variants(counts, least_length=6, least_count=5, ratio=5)


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_quality_rules, op3_best_fit_packing, op4_exact_top_k, op5_bpe_codec, op6_pii, op7_token_counts,
    op8_quality_classifier, op9_simhash, op10_license_scan, op11_alignment, op12_nnls_packing, op13_spelling)}
ORACLES = {
    "op2_quality_rules": quality_rules_sql(),
    "op4_exact_top_k": TOP_K_SQL,
}
