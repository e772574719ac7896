"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result to the
shared folder as Parquet and reads it back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.llm import jaccard, mixing, packing, pii, quality
from tarnwood.llm.entries import tokenizer_path
from tarnwood.llm.shared import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps."""
    return quality.quality_cascade(docs).where("kept").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 80 % one row, that of the smallest doc_id.

    Rows are told apart by numbers of their own, so rows that repeat a doc_id or have none are
    compared like all others; a null doc_id comes last. Texts without words stay.
    """
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = written(jaccard.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), width=5, percent=80).where("doc_id <> component_id").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "near-copies")
    tops = groups.select(F.col("_group").alias("_row"), "_group").distinct()
    members = rows.select("_row", "doc_id").join(groups.union(tops), "_row")
    kept = members.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("k")).select("k._row")
    gone = written(members.select("_row").join(kept, "_row", "left_anti"), "gone")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the new text."""
    return pii.pseudonymise(docs, pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs.withColumn("size", mixing.word_count(F.col("text"))))
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack),
]

#: Shingle links and tokenizer ids can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
