"""The corpus pipeline: documents in, packed sequences out.

``STAGES`` are functions of (spark, docs, sf_dir); each works on all rows that the one before kept, and ``run`` writes and rereads
what lies between. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratachain.llm import op2_packing, op4_neardup, op5_toxicity, op9_substring
from stratachain.llm.base import held_out, staged
from stratachain.llm.op10_bpe import default_tokenizer


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores at ``op5_toxicity.CUT`` or above. It is fitted as op5 fits it, on a bounded
    sample of this stage's labelled rows. Empty documents and ones without label are scored like all others."""
    model = op5_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 3, 1))
    rows = docs.select("text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    return op5_toxicity.scored(rows, model, ("row",)).where(F.col("score") < op5_toxicity.CUT).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates (five words a shingle, Jaccard likeness of 0.8 or more).
    Rows are known by id and text, so that different texts of one id are kept or go each by itself; of one id's near copies that of the
    smallest hash stays, of rows with equal id and text the least by all columns. Rows without id stay."""
    text = F.xxhash64("text")
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), text.alias("hash")))
    kept = op4_neardup.near_duplicates(docs.select(key.alias("doc_id"), "text"), size=5, percent=80).where("kept").select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.hash").alias("_hash")).distinct()
    rows = docs.where("doc_id is not null").withColumn("_hash", text).join(kept, ["doc_id", "_hash"], "left_semi")
    one = rows.groupBy("doc_id", "_hash").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return one.select(*(F.col(f"_row.`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each byte that a 50-byte string covers which also starts in a document of a smaller id, and characters cut in part.
    Every document stays, if need be with an empty text; n_chars follows the text."""
    cut = op9_substring.remove_repeats(docs, as_text=True)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048, a row a piece."""
    return op2_packing.pack_documents(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: SQL can't express the trained classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
