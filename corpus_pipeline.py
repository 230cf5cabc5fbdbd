"""The corpus pipeline: documents are filtered, deduplicated, decontaminated and encoded, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it again for the next one. All but
the last return the columns of documents, whatever further ones there are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import leaks, neardups, quality, sentencepieces, suffixes
from pulsegrid.llm.common import table, written

#: No SQL expresses hashed ratios, suffix sorting or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """``_doc`` (all columns), doc_id and text: so that no column of documents clashes with what a stage makes."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null texts have no words and go."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(packed(docs), trusted, keep=("_doc",)).where("kept").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the smallest doc_id, once; rows are told apart by doc_id and text, see ``neardups.keep_one``."""
    return neardups.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat anywhere; n_chars follows the text, a null text stays null."""
    cut = suffixes.remove_repeats(packed(docs).withColumn("_doc", F.col("_doc").dropFields("text")).withColumn("_null", F.col("text").isNull()), keep=("_doc", "_null"))
    text = F.when(~F.col("_null"), F.col("kept_text"))
    made = {"text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))} if "n_chars" in docs.columns else {})
    return cut.select(*[made.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item in their own text, whatever their doc_id."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    return sentencepieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
