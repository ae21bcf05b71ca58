"""Queries of this subpackage, by name: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op01_tokens, op02_bpe, op03_lines, op04_substrings, op05_simhash, op06_html, op07_decontaminate, op08_secrets, op09_quality, oracles, shared
from lodestone.llm import op10_language as ppm
from lodestone.llm import op11_search as lexical
from lodestone.llm import op12_neighbours as nearest
from lodestone.llm import op13_negatives as negatives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.scratch(spark, "tokens")
    op01_tokens.write_store(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    found = shared.written(op01_tokens.read_store(spark, path, ids=False), "places")
    return op01_tokens.with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op03_lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op04_substrings.dedup_substrings(table(spark, sf_dir, "documents"), 35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_html.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op07_decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_secrets.digests(op08_secrets.scan(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op09_quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.predict(docs, ppm.learn(docs))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents"))
    found = shared.written(lexical.search(index, table(spark, sf_dir, "benchmark"), k=50), "ranked")
    index.drop()
    return found


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, positives=5, negatives=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_tokens, op2_bpe, op3_lines, op4_substrings, op5_simhash, op6_html, op7_decontaminate, op8_secrets, op9_quality, op10_language, op11_search, op12_neighbours, op13_negatives)}
SQL: dict[str, str] = {"op3_lines": oracles.LINES, "op4_substrings": oracles.SUBSTRINGS, "op7_decontaminate": oracles.DECONTAMINATE, "op11_search": oracles.SEARCH, "op13_negatives": oracles.NEGATIVES}
