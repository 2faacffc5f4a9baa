"""The corpus pipeline: toxic and poor documents go, near-duplicates and repeated passages go, the rest is packed.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents; rows may have nulls anywhere, repeated rows and any
further columns (which are not passed on), and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import Stage, table
from siltworks.llm.minhash import MOST_BROADCAST, near_duplicates
from siltworks.llm.packing import pack_documents
from siltworks.llm.quality import quality_rules
from siltworks.llm.suffixes import remove_repeats
from siltworks.llm.toxicity import held_out, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar calls toxic go. Labels held out for its test are not learned from."""
    labelled = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity(spark, docs, labelled, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counting rules or are too far from every language go."""
    return quality_rules(spark, docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of least doc_id stays. Rows go
    by id and text, so that of an id with several texts only those go that have an earlier copy."""
    stage = Stage(spark, "near-duplicates")
    gone = stage.write(near_duplicates(spark, docs, width=5).where("NOT kept").select("doc_id", "text_hash").distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    return docs.withColumn("text_hash", F.xxhash64("text")).join(side, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters go all of whose bytes lie in a 100-byte string that starts earlier too; n_chars is counted anew."""
    left = remove_repeats(spark, docs, whole_characters=True, keep=["lang", "source"])
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left in sequences of at most 1024 tokens."""
    return pack_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack),
]

#: Learned grammars, suffix blocks and packing plans have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, function in STAGES:
        following = stage.write(function(spark, docs, sf_dir), name)
        if hasattr(docs, "_siltworks_path"):
            stage.drop(docs)
        docs = following
    return docs
