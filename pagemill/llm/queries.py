"""The operators bound to the test tables, one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bytebpe, clusters, decontaminate, embeddings, linededup, lmscore, minhash, mixing, pii, runs, token_counts, token_files, toxicity
from pagemill.llm.common import WORD, held_out, new_folder, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.train_and_score(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are those of the base spans; ``spans`` holds the added ones, too."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def number(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    return found.select("doc_id", *map(number, range(4)), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache each time, so every text counts as new."""
    docs = table(spark, sf_dir, "documents")
    out = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-cache"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_inertia(*clusters.cluster(table(spark, sf_dir, "embeddings")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _looped(docs: DataFrame) -> DataFrame:
    """One text in ten, by the digest of its id, with its words repeated from some word on."""
    h, n, g = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("w"), F.floor(F.col("h") / 10)
    one = docs.where(F.col("text").rlike(WORD) & (h % 10 == 0)).select("doc_id", h.alias("h"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    one = one.withColumn("a", (g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    one = one.select("doc_id", F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), n), " ").alias("text"))
    rest = docs.where(~F.coalesce(F.col("text").rlike(WORD) & (h % 10 == 0), F.lit(False)))
    return one.unionByName(rest.select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_looped(table(spark, sf_dir, "documents")))
    none = F.expr("CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)")
    # Fractions are compared crosswise, so exactly; of equal ones the first stays.
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    named = (op1_lm_scoring, op2_toxicity, op3_mixing, op4_token_files, op5_pii, op6_minhash, op7_line_dedup, op8_token_counts, op9_decontamination, op10_embeddings, op11_centroid_clustering, op12_byte_bpe, op13_periodic_runs)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": linededup.ORACLE, "op11_centroid_clustering": clusters.ORACLE, "op13_periodic_runs": runs.ORACLE}
