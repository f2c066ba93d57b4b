"""A corpus pipeline over the documents table: each stage works on all that its predecessor kept.

Stages: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut out,
contaminated documents go, and what is left is packed into training sequences. Every stage but the last returns
the columns of documents; each result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, packing, simhash, substring_dedup, toxicity
from veilspark.llm.common import small, stage

#: Documents that score this much or more are rejected.
TOXIC = 0.7
#: Texts of this similarity or more are near duplicates.
SIMILAR = 0.8
_NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, scores below TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    packed = docs.select("text", F.struct("*").alias("row"))
    return toxicity.score(packed, model).where(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group; repeated rows of it count once.

    Groups are connected by links of texts whose sets of 5-word shingles have a similarity of 0.8 or more. Documents
    without doc_id come after all others; if a group has no other, one of them stays.
    """
    groups = simhash.near_copies(docs, similarity=SIMILAR)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = groups.groupBy("root").agg(F.min(order).alias("first"))
    kept = first.select(F.coalesce(F.col("first.doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), F.col("first.mark").alias("mark")).distinct()
    packed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("mark"), F.struct("*").alias("row"))
    return packed.join(kept, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.any_value("row").alias("row")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; where a passage is cut, text is the words left, joined by one space, and n_chars its length."""
    found = substring_dedup.remove_repeats(docs.select("doc_id", "text", F.struct("*").alias("row")))
    cut = F.size("removed") > 0
    names = [f.name for f in docs.schema]
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is in a window of a benchmark item."""
    found = decontaminate.decontaminate(
        docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")
    )
    bad = found.where("contaminated").select(F.col("doc_id.doc_id").alias("bad_id"), F.col("doc_id.mark").alias("bad_mark"))
    bad = small(stage(bad.distinct(), "contaminated"))
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["bad_mark"])
    return docs.join(bad, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: A trained network decides the first stage, which SQL cannot express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
