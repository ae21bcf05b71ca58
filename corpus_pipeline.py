"""The corpus pipeline: stages in order, each of one operator, each on what the stage before it kept.

The driver writes each stage's rows as Parquet and reads them again as the next one's docs; run()
does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op02_bpe, op03_lines, op05_simhash, op07_decontaminate, op10_language, shared
from lodestone.llm.queries import table, tokenizer

#: A text goes if no language takes at least this share of the posterior.
LEAST_SCORE = 0.5


def placed(docs: DataFrame) -> DataFrame:
    """docs with its columns but doc_id and text named by their places, so that nothing an operator adds can clash."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays open."""
    flat = placed(docs)
    found = op10_language.predict(flat, op10_language.learn(docs), carry=True)
    return found.filter((F.col("lang_pred") != op10_language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*flat.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a document that loses all its lines goes."""
    flat = placed(docs)
    found = op03_lines.dedup_lines(flat)
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        n_chars = flat.columns[docs.columns.index("n_chars")]
        left = left.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.length("text").cast(flat.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return left.select(*flat.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group whose five-word shingles have a similarity of 0.8 or more."""
    return op05_simhash.keep_one(placed(docs), similarity=0.8, shingle=5).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    return op07_decontaminate.clean_documents(placed(docs), table(spark, sf_dir, "benchmark"), size=10).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of the documents that are left."""
    return op02_bpe.encode_digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
