"""One query an operator, over the whole of its table, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import decontaminate, fill_in_middle, html_text, line_dedup, mixing, ngram_join, pii, pitman_yor, secrets, tokens, topk, toxicity, vector_codes
from twinloom.llm.common import id_remainder, read

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents"))


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.judged(hits).select(*decontaminate.DIGEST)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_digest(tokens.write_tokens(read(spark, sf_dir, "documents"), TOKENIZER))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(found.codes).select("vec_id", "code", "error", "label_error", F.lit(found.codebooks_sha256).alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_pii_skip_chain,
        op3_html_layout,
        op4_decontamination,
        op5_pitman_yor,
        op6_source_mix,
        op7_toxicity,
        op8_token_files,
        op9_top_k,
        op10_secret_scan,
        op11_line_dedup,
        op12_vector_codes,
        op13_fill_in_middle,
    )
}

ORACLE_SQL = {
    "op4_decontamination": decontaminate.DECONTAMINATE_SQL,
    "op6_source_mix": mixing.MIX_SQL,
    "op9_top_k": topk.TOP_K_SQL,
    "op11_line_dedup": line_dedup.LINE_DEDUP_SQL,
    "op12_vector_codes": vector_codes.VECTOR_CODES_SQL,
    "op13_fill_in_middle": fill_in_middle.FILL_IN_MIDDLE_SQL,
}
