"""The pipeline over documents: STAGES in their order, and run().

Toxic rows go, one row of each group of near copies stays, secrets are masked, sources are mixed to their
target weights, and what is left is encoded. All stages but the last return the columns of documents, and each works on
all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.bpe import bpe_digests
from tabloom.llm.common import cut, narrow
from tabloom.llm.mixing import in_order, mixed
from tabloom.llm.near_dups import near_duplicates
from tabloom.llm.queries import tokenizer_path
from tabloom.llm.secrets import redact
from tabloom.llm.toxicity import accepted


#: What the key of a row within a stage is called, as doc_ids can be null or repeated; longer where a column has the name.
ROW = "tabloom_row"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rows whose texts the machine rejects go, whatever their doc_ids are."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies (similarity of 0.8 or more) the row with the least doc_id stays.

    Each row is a document of its own here: of rows that share their doc_id one stays if they are copies and all if they
    are not, and rows without a doc_id are linked too, but stay only if none of their group has one. Texts without words
    are copies of nothing.
    """
    key = ROW
    while key in docs.columns:
        key += "_"
    rows = cut(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    near = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent=80).select(F.col("doc_id").alias("row"), "component_id")
    members = cut(near.join(rows.select(F.col(key).alias("row"), "doc_id"), "row"), "near-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    groups = cut(members.groupBy("component_id").agg(first.alias("stays"), F.count("*").alias("n")).filter("n > 1").select("component_id", "stays"), "near-groups")
    gone = cut(members.join(narrow(groups, groups.count()), "component_id").filter(F.col("row") != F.col("stays")).select(F.col("row").alias("gone")), "near-copies")
    return rows.join(narrow(gone, gone.count()), rows[key] == gone["gone"], "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets in texts are masked, and n_chars follows; every document stays."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the same documents, in files that follow the schedule of their sources' blocks."""
    return in_order(mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids and decoded text of every document, as digests."""
    return bpe_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("bpe encoding and decoding", encode),
]
#: The stages hold learned models and a tokenizer: SQL can't express them; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{i}")
    return docs
