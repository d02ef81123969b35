"""A corpus from raw documents to packed bins, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns the columns of documents; the last returns the bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import lines, minhash, mixing, packing, toxicity
from voxmill.llm.text import free_name
from voxmill.session import checkpoint

ORACLE_SQL = None  # a trained network, alignments and random rounding: tests hold each stage against a plain version


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, predicts to be toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document goes if nothing of its text is left by that.

    Where the text has changed and there is a column n_chars, it is counted anew.
    """
    deduped = lines.dedup_lines(docs)
    empty = (F.col("deleted_lines") > 0) & (F.trim("text") == "")
    kept = deduped.where(~F.coalesce(empty, F.lit(False)))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("deleted_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed)
    return kept.select(*(f"`{c}`" for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document of the smallest id stays; of its rows with the same text, one.

    Rows of one doc_id with different texts are one document, which keeps them; rows without a doc_id stay.
    """
    found = minhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_and("kept").alias("kept"))
    mark = free_name(docs.columns, "_mark")
    marked = docs.join(checkpoint(found.where("rows > 1 or not kept")).select("doc_id", F.struct("rows", "kept").alias(mark)), "doc_id", "left")
    once = marked.where(F.col(mark).isNull())
    again = marked.where(F.col(mark)["kept"]).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*(f"`{c}`" for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All words of all documents in bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line dedup", without_repeated_lines),
    ("minhash near-dedup", one_of_each_group),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = checkpoint(docs)
    return docs
