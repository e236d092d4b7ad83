"""The corpus pipeline: from raw documents to packed sequences.

Every stage takes what its predecessor kept and returns a DataFrame; ``run`` writes each to the shared scratch folder
and reads it again. All but the last return the five columns of ``documents`` and no others, with ``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperline.llm import packing, secret_scan, simhash, suffix_dedup, toxicity
from vesperline.llm._spark import as_table, table
from vesperline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    n_chars = F.coalesce(F.length("text"), F.col("n_chars")).cast(like.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", n_chars).select(COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3, by a model of the labelled ones."""
    docs = docs.select(COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in five-word shingles to 0.8 or more: that with the smallest id."""
    return simhash.drop_similar(docs.select(COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 100-byte strings that start earlier; a character that a cut splits goes whole. A text
    that repeats in full stays as an empty one, so that no id is lost."""
    out = suffix_dedup.remove_repeats(docs, carry=["text", "lang", "source", "n_chars"], whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return _counted(out.withColumn("text", text), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked, also those under nested encodings."""
    return _counted(secret_scan.redact_secrets(docs.select(COLUMNS)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("suffix_array_dedup", without_repeats),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: SQL can express none of the stages in full; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
