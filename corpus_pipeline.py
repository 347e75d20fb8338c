"""A corpus pipeline of five stages over `documents`; counted as part of the subpackage llm.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of
documents; the last adds token ids. SQL can't express the models, so ORACLE_SQL is None and the tests compare
each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, decontaminate, near_dedup, quality, quality_rules
from lumenfold.llm.common import dealt, table
from lumenfold.session import materialize

#: Documents whose probability of good quality is less go.
LEAST_QUALITY = 0.5
#: Words of a shingle and least similarity, in percent, of near copies.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Words of a benchmark window, and the hit share beyond which a whole document goes.
WINDOW, MOST_LEAKED = 10, 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rates as good; null and empty texts are rated as texts without words."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rated = quality.rate(dealt(docs, "doc_id", "text"), model, out="__rating")
    return rated.where(F.col("__rating.tail_probability") >= LEAST_QUALITY).select(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep.

    The field is fitted on labelled rows of the whole documents table: the first stage has left hardly any
    bad ones.
    """
    field = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    ruled = quality_rules.label_lines(dealt(docs, "doc_id", "text"), field, out="__rules")
    return ruled.where("__rules.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies; rows that share a doc_id stay together."""
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), n=SHINGLE_WORDS, percent=SIMILARITY)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out, and documents mostly hit go."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), window=WINDOW, out="__leaks")
    clean = decontaminate.remove_leaks(found, leaks="__leaks", coverage=MOST_LEAKED)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, the number of these, and whether the ids decode to the text."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(docs, path, pattern, out="__decoded")
    same = F.col("__decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return both.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules_stage),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; what a stage returns goes through the shared folder to the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
